"""Personal data: patterns, and a character-level BiLSTM-CRF that adds what patterns miss.

The base is exact: email, ip, card and phone by their patterns, leftmost and
non-overlapping per kind. The tagger (``tagger.py``) is trained on the spans that the
patterns label in a bounded sample of ``TRAIN_TEXTS`` texts (smallest hash first), and on
rewritten ones that the patterns cannot see (a phone without its plus, an address with
blanks around the at sign). It reads whole texts in overlapping windows; windows without
any digit or at sign are skipped, because no span of any kind can lie in them. Decoded
spans of all windows of a text are reconciled together: the set of non-overlapping spans
with the largest total confidence is taken, and added where it meets no base span.

An added span must be confident (``SURE``) and have the make-up of its kind: an at sign for an
email, four numbers for an ip, 14 to 19 digits for a card, 10 to 15 for a phone.

Defined results: null counts as empty text and has no spans; positions are code points, end
exclusive; repeated rows give equal rows; with no labelled span in the corpus nothing is
added; counts and base_sha256 are of base spans; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of
from .tagger import PAD, Tagger, classes

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN, JOIN = 96, 48, 32, 24
TRAIN_TEXTS, TRAIN_WINDOWS = 500, 1600
SURE = 0.9

ANCHOR = re.compile("[0-9@]")
ZONE = re.compile(r"[0-9@](?:[^0-9@]{0,%d}[0-9@])*" % JOIN)
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of [0-9]+ can only start at the start of a run of digits, and takes all of it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Email spans: from each at sign leftward over the local part and rightward over the domain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                last = m.end()
                out.append((start, last, "email"))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by start, then kind."""
    found = emails(text)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows that cover every zone around digits and at signs."""
    starts: list[int] = []
    for m in ZONE.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        a = max(a, starts[-1] + STRIDE) if starts and starts[-1] + STRIDE > a else a
        while True:
            starts.append(a)
            if a + WINDOW >= b:
                break
            a += STRIDE
    return starts


def window_classes(coded: np.ndarray, start: int) -> np.ndarray:
    part = coded[start:start + WINDOW]
    return part if len(part) == WINDOW else np.append(part, np.full(WINDOW - len(part), PAD, part.dtype))


def labels_of(length: int, spans: list[Span]) -> np.ndarray:
    """Label per character: 0 none, 1 + 2k the first character of kind k, 2 + 2k a later one."""
    y = np.zeros(length, np.int8)
    for a, b, kind in spans:
        if not y[a:b].any():
            y[a:b] = 2 + 2 * KINDS.index(kind)
            y[a] -= 1
    return y


def rewritten(text: str, spans: list[Span], turn: int) -> tuple[str, list[Span]]:
    """The text with its phones and emails in forms that the patterns do not match, and their spans."""
    out, moved, last = [], [], 0
    size = 0
    for a, b, kind in spans:
        if a < last:
            continue
        piece = text[a:b]
        if kind == "phone":
            piece = re.sub(r"^\+[0-9]{1,2}[ .-]?", "", piece) if turn % 2 else piece[1:]
            piece = piece if sum(c.isdigit() for c in piece) >= 10 else piece
        elif kind == "email":
            piece = piece.replace("@", (" @ ", "@ ", " @")[turn % 3])
        out.append(text[last:a])
        size += a - last
        moved.append((size, size + len(piece), kind))
        out.append(piece)
        size += len(piece)
        last = b
    out.append(text[last:])
    return "".join(out), moved


def train(texts: list[str]) -> Tagger | None:
    """A tagger from the pattern spans of the texts; None where they have none."""
    xs, ys, some = [], [], False
    for n, text in enumerate(texts):
        spans = base_spans(text)
        some = some or bool(spans)
        forms = [(text, spans)]
        if any(kind in ("phone", "email") for *_, kind in spans):
            forms.append(rewritten(text, spans, n))
        for form, marked in forms:
            coded, y = classes(form), labels_of(len(form), marked)
            for start in windows(form)[:12]:
                xs.append(window_classes(coded, start))
                part = y[start:start + WINDOW]
                ys.append(np.append(part, np.zeros(WINDOW - len(part), np.int8)))
    if not some:
        return None
    order = np.random.default_rng(1).permutation(len(xs))[:TRAIN_WINDOWS]
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.fit(np.array(xs)[order], np.array(ys)[order])
    return tagger


def learn(docs: DataFrame, text_col: str) -> Tagger | None:
    """Fit on a bounded sample of the texts that have a digit or an at sign."""
    some = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    # Only hashes are ranked; the texts are fetched afterwards.
    ranked = some.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(TRAIN_TEXTS)
    last = ranked.agg(F.max("h")).first()[0]
    if last is None:
        return None
    rows = some.filter(F.xxhash64("text") <= last).dropDuplicates(["text"]).limit(TRAIN_TEXTS + 8).collect()
    return train(sorted(r[0] for r in rows))


def plausible(text: str, kind: str) -> bool:
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "email":
        return "@" in text.strip()[1:-1] and "." in text.split("@")[-1]
    if kind == "ip":
        return text.count(".") >= 3 and 4 <= digits <= 12
    return 14 <= digits <= 19 if kind == "card" else 10 <= digits <= 15


def decoded(path: np.ndarray, sure: np.ndarray, start: int, end: int, limit: int) -> list[tuple[int, int, str, float]]:
    """Spans (with confidence) of one window; those cut by an inner window edge are left to the next window."""
    out, i = [], 0
    n = min(len(path), limit - start)
    while i < n:
        if path[i] == 0:
            i += 1
            continue
        kind, j = (path[i] - 1) // 2, i + 1
        while j < n and path[j] == 2 + 2 * kind:
            j += 1
        inner = (i > 0 or start == 0) and (j < n or end >= limit)
        if inner:
            out.append((start + i, start + j, KINDS[kind], float(sure[i:j].mean())))
        i = j
    return out


def reconciled(candidates: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The non-overlapping candidates with the largest total of confidence times length."""
    spans = sorted(set(candidates), key=lambda s: (s[1], s[0]))
    ends = [s[1] for s in spans]
    best: list[tuple[float, int, int]] = [(0.0, -1, 0)]  # total, span taken, where to go on
    for k, (a, b, _, p) in enumerate(spans):
        j = int(np.searchsorted(ends, a, "right"))
        j = min(j, k)
        with_it = best[j][0] + p * (b - a)
        best.append((with_it, k, j) if with_it > best[k][0] else (best[k][0], -1, k))
    out, k = [], len(spans)
    while k > 0:
        _, taken, to = best[k]
        if taken >= 0:
            out.append(spans[taken])
        k = to
    return out[::-1]


def added_spans(texts: list[str], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """Per text the spans that the tagger adds to the base."""
    jobs = [(i, s) for i, t in enumerate(texts) for s in windows(t)]
    coded = {i: classes(texts[i]) for i in {i for i, _ in jobs}}
    found: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    for a in range(0, len(jobs), 2048):
        part = jobs[a:a + 2048]
        e = tagger.emissions(np.array([window_classes(coded[i], s) for i, s in part]))
        paths = tagger.decode(e)
        p = np.exp(e - e.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        kinds = np.stack([p[:, :, 0], *[p[:, :, 1 + 2 * k] + p[:, :, 2 + 2 * k] for k in range(len(KINDS))]], axis=2)
        for r in np.flatnonzero(paths.any(axis=1)):
            i, s = part[r]
            sure = kinds[np.arange(WINDOW), r, (paths[r] + 1) // 2]
            found[i] += decoded(paths[r], sure, s, s + WINDOW, len(texts[i]))
    out = []
    for text, spans, candidates in zip(texts, base, found):
        new = []
        for a, b, kind, p in reconciled(candidates) if candidates else []:
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if p >= SURE and plausible(text[a:b], kind) and not any(x < b and a < y for x, y, _ in spans):
                new.append((a, b, kind))
        out.append(new)
    return out


def spans_of(df: DataFrame, tagger: Tagger | None) -> DataFrame:
    """(key, base, added) for rows of (key, text): span lists as structs (start, end, kind)."""
    kind = df.schema["key"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            base = [base_spans(t) if ANCHOR.search(t) else [] for t in texts]
            some = [i for i, t in enumerate(texts) if ANCHOR.search(t)] if tagger else []
            added: list[list[Span]] = [[] for _ in texts]
            for i, new in zip(some, added_spans([texts[i] for i in some], [base[i] for i in some], tagger)) if some else []:
                added[i] = new
            lists = [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in row] for row in rows], span) for rows in (base, added)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *lists], names=["key", "base", "added"])

    kinds = "array<struct<start: bigint, end: bigint, kind: string>>"
    return df.mapInArrow(run, f"key {kind}, base {kinds}, added {kinds}")


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets."""
    out, last = [], 0
    for a, b, kind in in_order(spans):
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
            last = b
        last = max(last, b)
    return "".join(out) + text[last:]


def digest(base: list, added: list) -> tuple[str, str]:
    """base_sha256 and the list of all spans, as text."""
    own = [(s["start"], s["end"], s["kind"]) for s in base]
    all_ = in_order(own + [(s["start"], s["end"], s["kind"]) for s in added])
    return hashlib.sha256(written_out(own).encode()).hexdigest(), written_out(all_)


def op1_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spans_of(docs.select(F.struct("doc_id").alias("key"), text_of("text").alias("text")), learn(docs, "text"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def text(spans):
        rank = F.array_sort(F.transform(spans, lambda s: F.struct(
            s["start"], F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(rank, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        F.col("key.doc_id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.concat("base", "added")).alias("spans"))
