"""Seconds per operator on a generated catalog: generated.py [files]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, functions as F  # noqa: E402

from catalogspark.functions import text  # noqa: E402
from catalogspark.operators import aliases, catalog, index, screen, search  # noqa: E402
from catalogspark.plans.bindings import EXTRA_TERMS, RULE, TERMS  # noqa: E402
from catalogspark.session import configure  # noqa: E402
from catalogspark.sources.offers import generate_offers  # noqa: E402


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 1_000_000
    builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    spark = configure(builder.config("spark.sql.shuffle.partitions", "16")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def timed(label, df):
        start = time.time()
        df.write.format("noop").mode("overwrite").save()
        print(f"{label}: {time.time() - start:.1f} s", flush=True)

    offers = catalog.with_complete(generate_offers(spark, n)).persist()
    timed("generate", offers)
    files, sources = catalog.files(offers).persist(), catalog.sources(offers).persist()
    timed("files", files)
    timed("sources", sources)
    postings = index.postings(files).persist()
    timed("postings", postings)
    timed("screen", screen.screen(files, screen.Policy(terms=TERMS, extra_terms=EXTRA_TERMS, rule=RULE)))
    # Two neighbouring words of every name as a query, for a thousand names.
    asked = files.orderBy("file_hash").limit(1000).select(
        F.col("file_hash").alias("query_id"), F.slice(text.tokens(F.col("name")), 1, 2).alias("tokens")
    )
    timed("batch search, 1000 queries", search.batch_search(files, postings, asked))
    timed("alias detection", aliases.alias_records(offers))


main()
