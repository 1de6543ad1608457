"""Retrieval sanity check for one topic (on-demand ingest, then search).

    python tools/sanity.py PAGES_PARQUET STORE_DIR [--topic T] [--query Q] [--k 4]

Exit code: 0 ok, 1 retrieval error, 2 fewer hits than k, 3 a required field
missing, 4 empty text or url; the hits are printed with 100-character
previews.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from folio.functions.text import preview  # noqa: E402
from folio.operators.checks import health_check  # noqa: E402
from folio.operators.search import RetrievalError  # noqa: E402
from folio.operators.store import ChunkStore  # noqa: E402
from folio.plans.service import Retrieval  # noqa: E402
from folio.session import get_session  # noqa: E402


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("pages")
    ap.add_argument("store")
    ap.add_argument("--topic", default="Linear algebra")
    ap.add_argument("--query", default="eigenvalues")
    ap.add_argument("--k", type=int, default=4)
    args = ap.parse_args()
    spark = get_session("local[4]", app_name="folio-sanity")
    spark.sparkContext.setLogLevel("ERROR")
    svc = Retrieval(spark, ChunkStore(spark, args.store), spark.read.parquet(args.pages))
    try:
        hits = svc.get_chunks_one(args.topic, args.query, args.k).cache()
    except (RetrievalError, ValueError) as e:
        print(f"[fail] retrieval error: {e}")
        return 1
    req = spark.createDataFrame([(0, args.topic.strip(), args.k)], "query_id long, topic string, k int")
    code = health_check(req, hits).first()["code"]
    for r in hits.select("rank", "score", "tokens", F.col("source.url").alias("url"),
                         preview("text", 100).alias("p")).orderBy("rank").collect():
        print(f"  {r.rank:>2}. score={r.score:.4f} tokens={r.tokens} url={r.url}")
        print(f"      {r.p}")
    print("ALL GOOD" if code == 0 else f"[fail] code {code}")
    return int(code)


if __name__ == "__main__":
    sys.exit(main())
