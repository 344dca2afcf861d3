"""KEY=VALUE files for the environment."""

from __future__ import annotations

import os
import re

_LINE = re.compile(r"""^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(?:"([^"]*)"|'([^']*)'|(.*?))\s*(?:(?<=\s)#.*)?$""")


def load_env(path: str, override: bool = False) -> dict[str, str]:
    """Reads a file into the environment and returns what it set; variables that are set win unless overridden.

    A comment begins at a # behind white space, so one inside a value belongs to it.
    """
    if not os.path.exists(path):
        return {}
    found = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            if m := _LINE.match(line):
                key, value = m[1], next(x for x in (m[2], m[3], m[4]) if x is not None)
                if override or key not in os.environ:
                    os.environ[key] = found[key] = value
    return found
