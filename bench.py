"""Times the headline queries: one JSON line, with the median of warm runs a query.

A line a query goes to the error output as it ends. Past the time limit the other queries are left out, and named.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = ("token_freq_table", "token_type_counts", "bigram_freq", "bm25_l2", "sentence_count", "doc_sentiment", "entity_type_freq", "pos_default_tags", "readability", "sentence_importance", "custom_entities")
RUNS, LIMIT = 3, 1400


def main() -> None:
    began = time.perf_counter()
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "6g", "spark.sql.files.maxPartitionBytes": "2m"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from textloom.plans.queries import QUERIES

    n_tokens = QUERIES["token_count_by_lang"](spark, folder).agg({"n_tokens": "sum"}).first()[0]
    took, left = {}, []
    for name in HEADLINE:
        own: list[float] = []
        while len(own) < RUNS and time.perf_counter() - began < LIMIT:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            own.append(time.perf_counter() - start)
        if own:
            took[name] = round(sorted(own)[len(own) // 2], 3)
            print(f"{name}: {took[name]} s, {round(n_tokens / took[name])} tokens a second", file=sys.stderr, flush=True)
        else:
            left.append(name)
    rates = {name: round(n_tokens / s) for name, s in took.items()}
    print(json.dumps({"metric": "sum of the queries' median seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "tokens": n_tokens, "tokens_per_sec": rates, "left_out": left, "cpus": int(cpus), "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
