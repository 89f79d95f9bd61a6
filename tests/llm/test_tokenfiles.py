"""Token files: exact round trips, and ids equal to plain encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalogspark.llm import tokenfiles as t

from .fixtures import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def numbers(rng, kind, n):
    return {
        "even": lambda: rng.integers(0, 50_257, n), "skewed": lambda: rng.zipf(1.3, n) % 50_257, "same": lambda: np.full(n, 7),
        "wide": lambda: rng.integers(0, 1 << 32, n), "lonely": lambda: np.where(np.arange(n) % 251 == 0, (1 << 32) - 1, 3), "zero": lambda: np.zeros(n),
    }[kind]().astype(np.uint32)


KINDS = ["even", "skewed", "same", "wide", "lonely", "zero"]


@pytest.mark.parametrize("kind", KINDS)
def test_blocks_round_trip(kind):
    ids = numbers(np.random.default_rng(1), kind, t.BLOCK * 21)
    data, sizes = t.packed_blocks(ids)
    starts = np.cumsum(sizes) - sizes
    assert sizes.sum() == len(data)
    assert np.array_equal(t.unpacked_blocks(data, starts), ids)
    assert np.array_equal(t.unpacked_blocks(data, starts[5:7]), ids[5 * t.BLOCK:7 * t.BLOCK])


def test_width_follows_the_percentile():
    """A few large ids are exceptions and do not widen the block."""
    ids = np.arange(t.BLOCK, dtype=np.uint32) % 16
    ids[:20] = 40_000
    data, sizes = t.packed_blocks(ids)
    assert data[4] == 4 and data[5] == 2 and sizes[0] == 8 + 32 * 4 + 3 * 20


@pytest.mark.parametrize("lengths", [[0, 1, 255, 256, 257, 0, 5000], [], [0, 0], [3]])
def test_file_round_trip(tmp_path, lengths):
    rng = np.random.default_rng(2)
    docs = [numbers(rng, KINDS[i % len(KINDS)], n) for i, n in enumerate(lengths)]
    names = [None, None, *range(-3, 100)][:len(docs)]
    path = f"{tmp_path}/one.tok"
    writer = t.TokenWriter(pa.OSFile(path, "wb"))
    for k in range(0, len(docs), 3):
        part = docs[k:k + 3]
        writer.add(names[k:k + 3], np.array([len(d) for d in part]), np.concatenate(part))
    writer.close()
    file = t.TokenFile(path)
    for together in (1, 300, 1 << 20):
        got = list(file.documents(together))
        assert [n for n, _ in got] == names
        assert all(np.array_equal(a, b) for (_, a), b in zip(got, docs))
    everything = np.concatenate([np.zeros(0, np.uint32), *docs])
    for a, b in ((0, 0), (0, 1), (10, 300), (255, 257), (600, 10 ** 9)):
        assert np.array_equal(file.read_ids(a, b), everything[a:b])


def test_not_a_token_file(tmp_path):
    (tmp_path / "x").write_bytes(b"0" * 100)
    with pytest.raises(ValueError):
        t.TokenFile(f"{tmp_path}/x")


ODD = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \n b", "a  b c", "x\x1c y", "don't  stop\t now ", "\n\n a\n", "é é", "12 34  5",
       "<|endoftext|> a <|endoftext|>", "a", "日本 語", " 　 x", "  y", "a  b"]


@pytest.mark.parametrize("end", [2, None])
def test_pieces_equal_plain_encoding(plain, end):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["a", "b ", " ", "\n", "7", ".", "'s", "é", "\t", " ", "語"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    with open(PATH) as f:
        encoder = t.Encoder(f.read())
    for part in (texts[:100], texts, texts[50:60]):
        n, ids = encoder.encode(pa.array(part, pa.string()), end)
        want = [plain(x) + ([] if end is None else [end]) for x in part]
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == sum(want, [])


def expected(rows, plain):
    out, at = [], 0
    for i, text in rows:
        ids = plain(text) + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def in_order(df):
    return [tuple(r) for r in sorted(df.collect(), key=lambda r: r.start)]


def test_files_of_a_table(spark, plain):
    """Null texts, long texts, more files than one; extra columns of the same names."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["red", "Wörter", "x1", "...", "longer-word"]) for _ in range(rng.choice([0, 1, 20, 400])))) for i in range(-5, 200)]
    rows += [(500, None), (501, ""), (502, "lang " * 60_000)]
    rng.shuffle(rows)
    df = documents(spark, rows).repartition(7)
    for c in ("id", "th", "n", "ids", "seq", "path"):
        df = df.withColumn(c, F.lit("x"))
    manifest = t.token_files(df, PATH, file_bytes=80_000)
    assert manifest.count() > 3
    assert in_order(t.documents_of(manifest)) == expected(sorted(rows), plain)


def test_repeated_rows_and_null_ids(spark, plain):
    rows = [(None, "b"), (None, "a"), (3, "same"), (3, "same"), (3, "other"), (1, "x")]
    got = in_order(t.documents_of(t.token_files(documents(spark, rows), PATH, file_bytes=2)))
    assert [r[0] for r in got] == [None, None, 1, 3, 3, 3]
    assert sorted(r[2:] for r in got if r[0] == 3) == sorted(r[2:] for r in expected([(3, "same"), (3, "same"), (3, "other")], plain))
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got])[:-1])


def test_empty_table(spark):
    manifest = t.token_files(documents(spark, []), PATH)
    assert manifest.count() == 0 and t.documents_of(manifest).count() == 0


def test_query(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = t.op11_token_files(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert in_order(got) == expected(rows, plain)


def test_new_pieces_go_through_the_tokenizer_together(plain):
    """Pieces cut at both ends share a call, and get the ids that they have alone; so do all others."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgé日😀'-.0 9\n<|>") for _ in range(rng.randint(1, 9))) for _ in range(6000)]
    pieces = list(dict.fromkeys([w if rng.random() < 0.3 else " " + w for w in words] + [" a", "a", " ", "  a", " a ", " a\n", " \u00a0a", " a\u3000", " <|endoftext|>", ""]))
    with open(PATH, encoding="utf-8") as f:
        encoder = t.Encoder(f.read())
    calls = []
    each = encoder.each
    encoder.each = lambda texts: (calls.append(len(texts)), each(texts))[1]
    ids, sizes = encoder.coded(pa.array(pieces, pa.large_string()))
    assert [a.tolist() for a in np.split(ids, np.cumsum(sizes)[:-1])] == [plain(p) for p in pieces]
    assert sum(calls) < len(pieces) * 0.7
    # A tokenizer whose tokens do not tell their bytes.
    encoder.n_bytes[:] = 1
    again, _ = encoder.coded(pa.array(pieces, pa.large_string()))
    assert np.array_equal(ids, again)
