"""``python -m evidentia.cli --warehouse DIR ask|status|search|migrate ...`` over a ``Store``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from evidentia.service import Core
from evidentia.session import session
from evidentia.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evidentia")
    p.add_argument("--warehouse", required=True)
    p.add_argument("--scopes", default="")
    p.add_argument("--viewer", default="")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("ask").add_argument("query")
    sub.add_parser("status")
    sub.add_parser("migrate").add_argument("--rollback", type=int)
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=0)
    return p


def main(argv: list[str] | None = None) -> int:
    """Questions are routed like any asker's; 1 if an answer is an error."""
    args = parser().parse_args(argv)
    store = Store(session("evidentia-cli"), args.warehouse)
    core, scopes = Core(store), [s for s in args.scopes.split(",") if s]
    if args.command == "migrate":
        print(json.dumps(store.migrate() if args.rollback is None else store.rollback(args.rollback)))
    elif args.command == "status":
        print(json.dumps(core.status(), default=str))
    elif args.command == "search":
        for hit in core.search(args.query, scopes, args.limit):
            print(json.dumps(hit))
    else:
        answer = core.ask(args.query, scopes, args.viewer)
        print(json.dumps(asdict(answer)))
        return int(answer.status == "error")
    return 0


if __name__ == "__main__":
    sys.exit(main())
