"""URL filters: one trie over reversed host labels, and below each host one over path segments.

The rules are a stated list; its size is checked before it is broadcast. A rule fits its host and all
subdomains when the url's path starts with the rule's path. The longest fitting rule wins: the one
with most host labels, among these the one with the longest path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import col, others

JUDGED = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
_URL = re.compile(r"://([^/?#]*)(/[^?#]*)?", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2] or "") if m else ("", "")


class _Paths:
    """Node of complete path segments; ends: rules whose last segment is a prefix of what follows, longest first."""

    __slots__ = ("ends", "next")

    def __init__(self):
        self.next: dict[str, _Paths] = {}
        self.ends: list[tuple[str, tuple[str, str]]] = []


class Trie:
    """Rules (verdict, host, path) in a trie of host labels from the right, then path segments from the left."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            paths = node.setdefault(None, _Paths())
            *whole, last = path.split("/")
            for segment in whole:
                paths = paths.next.setdefault(segment, _Paths())
            paths.ends = sorted([*(e for e in paths.ends if e[0] != last), (last, (host + path, verdict))], key=lambda e: -len(e[0]))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        found, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                found = self._path(node[None], segments) or found
        return found

    @staticmethod
    def _path(paths: _Paths, segments: list[str]) -> tuple[str, str] | None:
        found = None
        for at, segment in enumerate(segments):
            found = next((hit for prefix, hit in paths.ends if segment.startswith(prefix)), found)
            if at + 1 == len(segments) or segment not in paths.next:
                break
            paths = paths.next[segment]
        return found


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", max_rule_bytes: int = 64 << 20) -> DataFrame:
    """pages with host, path, rule (the winning one, or null) and verdict (its own, else default).

    A url that is null or has no "://" has empty host and path, which no rule with a host fits. Of
    rules with equal host and path the last one counts. Columns of pages with an output's name give way.
    Each row is judged for itself, so repeated rows and hot hosts need no grouping.
    """
    if (n := sum(len(h) + len(p) for _, h, p in rules)) > max_rule_bytes:
        raise ValueError(f"rules of {n} characters are more than max_rule_bytes; split the list and judge in turn")
    if wrong := [r for r in rules if r[0] not in ("allow", "block") or (r[2] and r[2][0] != "/")]:
        raise ValueError(f"a rule is (allow or block, host, path with a leading / or empty): {wrong[:3]}")
    held = pages.sparkSession.sparkContext.broadcast(list(rules))

    @F.arrow_udf("struct<host: string, path: string, rule: string, verdict: string>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Trie(held.value)
        for urls in batches:
            rows = []
            for u in urls.to_pylist():
                host, path = host_and_path(u)
                rule, verdict = trie.match(host, path) or (None, default)
                rows.append({"host": host, "path": path, "rule": rule, "verdict": verdict})
            yield pa.array(rows, JUDGED)

    kept = others(pages, ["host", "path", "rule", "verdict"])
    return pages.select(*map(col, kept), judge(col(url)).alias("__url")).select(*map(col, kept), "__url.*")
