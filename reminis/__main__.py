"""``python -m reminis status|health|export --path DIR [--user NAME] [--json]``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from reminis.api import MemoryStore, option


def main() -> None:
    parser = argparse.ArgumentParser(prog="reminis")
    parser.add_argument("command", choices=["status", "health", "export"])
    parser.add_argument("--path")
    parser.add_argument("--user", default="default")
    parser.add_argument("--json", action="store_true")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("reminis").getOrCreate()
    store = MemoryStore(spark, option("REMINIS_PATH", args.path, "~/.reminis"), args.user)
    if args.command == "export":
        print(store.export())
    elif args.command == "health":
        print(json.dumps([r.asDict() for r in store.health().collect()]))
    elif args.json:
        print(json.dumps(store.status(), default=str))
    else:
        found = store.status()
        print(f"facts: {found['fact_count']:,}\nlast ingestion: {found['last_ingestion'] or 'never'}\nbytes: {found['storage_bytes']:,}")


if __name__ == "__main__":
    main()
