"""python -m engramix ROOT COMMAND [ARGUMENT ...]: an Engine's methods from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from engramix.engine import Engine

COMMANDS = {
    "search": (str,), "stats": (), "salience": (), "tiers": (), "primer": (), "digest": (), "doctor": (), "proposals": (), "audit": (), "decisions": (),
    "kg-query": (str,), "kg-path": (int, int), "kg-impact": (int,), "kg-merge-preview": (), "kg-prune": (), "brief": (str,), "build-index": (), "kg-block": (str,), "compact": (int,),
    "decision-get": (str,), "decision-history": (str,), "kg-stats": (), "kg-facts": (str,), "tier-stats": (), "retention-stats": (), "archive-candidates": (), "pull-shared": (str,), "shared-stats": (),
    "insights": (), "profile": (), "search-stats": (), "provider-costs": (), "coverage": (), "pending-days": (), "distill": (str,), "redact": (str,), "noise-check": (str,), "temporal": (str,), "classify": (str,),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="engramix", description=__doc__)
    parser.add_argument("root")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("arguments", nargs="*")
    asked = parser.parse_args(argv)
    kinds = COMMANDS[asked.command]
    if len(asked.arguments) != len(kinds):
        parser.error(f"{asked.command} takes {len(kinds)} arguments")
    spark = SparkSession.builder.appName("engramix").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = getattr(Engine(spark, asked.root), asked.command.replace("-", "_"))(*(k(a) for k, a in zip(kinds, asked.arguments, strict=True)))
    for df in out if isinstance(out, tuple) else (out,):
        if isinstance(df, DataFrame):
            df.show(50, truncate=100)


if __name__ == "__main__":
    main()
