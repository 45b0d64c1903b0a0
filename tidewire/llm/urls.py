"""Operator 6: allow and block rules for URLs in a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of one trie at most: the trie is broadcast. More rules make more tries, which are asked in turn.
TRIE_RULES = 200_000

Rule = tuple[str, str, str]  # host, path, verdict


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there to ``?``, ``#`` or the end. Both empty for null or no ``://``."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    return lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


@dataclass
class Node:
    next: dict[str, "Node"] = field(default_factory=dict)
    paths: "Node | None" = None  # at a host's node: the trie of its paths' whole segments
    ends: list[tuple[str, str, str]] = field(default_factory=list)  # at a path's node: (beginning of the next segment, rule, verdict), longest first


def build_trie(rules: list[Rule]) -> Node:
    """Hosts by their labels from the last to the first, then paths by segment; what a path has after its last slash begins the next segment."""
    root = Node()
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.next.setdefault(label, Node())
        node.paths = node = node.paths or Node()
        *segments, start = path.split("/")
        for s in segments:
            node = node.next.setdefault(s, Node())
        node.ends.append((start, host + path, verdict))
        node.ends.sort(key=lambda e: (-len(e[0]), e[2] != "block"))
    return root


def longest_match(trie: Node, host: str, path: str) -> tuple[int, int, str, str] | None:
    """(host labels, path letters, rule, verdict) of the longest rule that fits: most host labels first, then the longest path; block before allow if both are equal."""
    node, best, segments = trie, None, path.split("/")
    for depth, label in enumerate(reversed(host.split(".")), 1):
        node = node.next.get(label)
        if node is None:
            break
        if node.paths is None:
            continue
        at, done, found = node.paths, 0, None
        for k, segment in enumerate(segments):
            last = k + 1 == len(segments)
            for start, rule, verdict in at.ends:
                if segment.startswith(start):
                    if found is None or done + len(start) > found[1]:
                        found = (depth, done + len(start), rule, verdict)
                    break
            at = None if last else at.next.get(segment)
            if at is None:
                break
            done += len(segment) + 1
        if found:
            best = found
    return best


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", columns: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """``columns``, host, path, rule and verdict of every row's URL; a URL that no rule fits has a null rule and the verdict ``default``.

    A rule fits its host and all subdomains if the URL's path begins with the rule's. Null, empty and broken URLs have an empty host and path and fit no rule;
    repeated rows are judged one by one. Rules are broadcast as tries of at most TRIE_RULES rules; with more, the longest match of all tries counts.
    """
    host, path = host_and_path(F.col("_url"))
    base = pages.select(*[F.col(f"`{c}`") for c in columns], F.col(url).cast("string").alias("_url")).select(*[F.col(f"`{c}`") for c in columns], host.alias("host"), path.alias("path"))
    held = [pages.sparkSession.sparkContext.broadcast(build_trie(rules[k : k + TRIE_RULES])) for k in range(0, len(rules), TRIE_RULES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [h.value for h in held]
        for b in batches:
            hosts, paths = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            found = [max((m for m in (longest_match(t, h, p) for t in tries) if m), key=lambda m: (m[0], m[1], m[3] == "block"), default=None) for h, p in zip(hosts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m and m[2] for m in found], pa.string()), pa.array([m[3] if m else default for m in found], pa.string())], names=[*b.schema.names, "rule", "verdict"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{schema}, rule string, verdict string")
