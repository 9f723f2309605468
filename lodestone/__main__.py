"""python -m lodestone serve|http|reindex|watch|status CONFIG.toml"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from lodestone.server import http_server, serve_lines
from lodestone.service import Service
from lodestone.sources.files import load_config
from lodestone.streaming.watch import watch_vault


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in ("serve", "http", "reindex", "watch", "status"):
        print(__doc__)
        return 2
    config = load_config(args[1])
    service = Service(SparkSession.builder.appName("lodestone").getOrCreate(), config)
    if args[0] == "serve":
        serve_lines(service, sys.stdin, sys.stdout)
    elif args[0] == "http":
        http_server(service).serve_forever()
    elif args[0] == "watch":
        watch_vault(service.spark, service.index, config.vault_path, f"{config.index_path}/watch", config.ignore).awaitTermination()
    else:
        print(json.dumps(service.reindex() if args[0] == "reindex" else service.status()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
