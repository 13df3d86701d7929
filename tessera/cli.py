"""``python -m tessera.cli format|to-json|from-json|frames [file]``: the library on one text, from a file or standard input."""

from __future__ import annotations

import argparse
import json
import sys

from . import values
from .operators.frames import split_frames


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("command", choices=["format", "to-json", "from-json", "frames"])
    p.add_argument("file", nargs="?")
    p.add_argument("--llm", action="store_true", help="ASCII null")
    p.add_argument("--compact", action="store_true", help="key numbers after a header")
    p.add_argument("--no-tabular", action="store_true")
    a = p.parse_args(args)
    raw = open(a.file, "rb").read() if a.file else sys.stdin.buffer.read()
    if a.command == "frames":
        found, end = split_frames(raw)
        for f in found:
            print(json.dumps({"sid": f[0], "seq": f[1], "kind": f[2], "len": f[4], "final": f[9], "error": f[10], "payload": f[5].decode(errors="replace")}, ensure_ascii=False))
        return int(end < len(raw) or any(f[10] for f in found))
    text = raw.decode()
    if a.command == "to-json":
        v = values.from_json(text) if text.lstrip()[:1] in ("{", "[") and _is_json(text) else values.parse(text)
        print(values.to_json(v, indent=2))
        return 0
    v = values.from_json(text)
    options = (values.LLM if a.llm else values.DEFAULT).replace(auto_tabular=not a.no_tabular)
    if a.compact:
        print(values.loose_with_schema(v, options.replace(keys=tuple(values.key_dictionary(v)))))
    else:
        print(values.loose(v, options))
    return 0


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


if __name__ == "__main__":
    sys.exit(main())
