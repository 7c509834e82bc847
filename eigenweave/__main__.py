"""Run an experiment, or show an operator at work.

python -m eigenweave --data FOLDER --dataset embeddings --partition dirichlet
python -m eigenweave --demo streaming
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.estimators import METHODS
from .plans.demos import DEMOS
from .plans.experiment import scorecard
from .sources import samples as src
from .sources.partition import DataPartitioner


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="eigenweave")
    p.add_argument("--demo", choices=sorted(DEMOS), help="a short run on generated data, instead of an experiment")
    p.add_argument("--data", help="folder of Parquet tables")
    p.add_argument("--dataset", default="embeddings", choices=sorted(src.DATASETS))
    p.add_argument("--partition", default="iid", choices=["iid", "dirichlet", "shard", "quantity_skew", "quantity"])
    p.add_argument("--num-clients", type=int, default=10)
    p.add_argument("--n-components", type=int, default=8)
    p.add_argument("--alpha", type=float, default=0.5)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--methods", nargs="*", choices=list(METHODS))
    p.add_argument("--out", help="folder for the scorecard, Parquet")
    a = p.parse_args(argv)
    if not a.demo and not a.data:
        p.error("one of --data and --demo is needed")
    spark = SparkSession.builder.getOrCreate()
    if a.demo:
        shown = DEMOS[a.demo](spark)
        shown.show(truncate=False)
        if a.out:
            shown.write.mode("overwrite").parquet(a.out)
        return
    rows = src.load(spark, a.data, a.dataset)
    params = {"alpha": a.alpha} if a.partition == "dirichlet" else {}
    parted = DataPartitioner(a.num_clients, a.seed).partition(rows, a.partition, **params)
    held = parted.where("label is not null")
    card = scorecard(spark, parted.where("row_id % 5 != 0"), held.where("row_id % 5 = 0"), a.n_components, a.methods, a.seed, classify=not held.isEmpty())
    card.show(truncate=False)
    if a.out:
        card.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
