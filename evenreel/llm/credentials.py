"""Secret scan with corpus-wide ownership frequency (operator 1).

Every whole text is scanned for assignments, access keys and hexadecimal keys
(the base spans), and for other tokens that look random. The hash of each value
is then counted over the corpus by distinct repositories and distinct owners. A
value that many owners or many repositories hold is an example somebody copied;
one that a single owner keeps in few repositories and that looks random is a
live-looking credential. Random-looking
tokens outside base spans are reported only if they are owner-specific; base
spans always stay and carry their class. Only hashes leave the scan.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenreel.llm.common import map_rows, row_ids
from evenreel.session import written

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "owned")
#: From so many owners on, a value is a widely copied example.
COPIED_OWNERS = 3
#: From so many repositories on, it is one too, even if one owner has them all.
COPIED_REPOS = 10
#: A value held by no more owners than this, in no more repositories, is owner-specific.
OWN_OWNERS = 1
OWN_REPOS = 3
#: Bits of entropy per character from which a value looks live.
LIVE_ENTROPY = 3.0

# re.ASCII: without it, ignoring case also matches letters such as the long s
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")


def entropy(value: str) -> float:
    """Shannon entropy in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, secret value), sorted; leftmost matches per kind."""
    found = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def other_tokens(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking tokens that touch no base span."""
    found = []
    for m in _TOKEN.finditer(text):
        if _MIXED.match(m[0]) and entropy(m[0]) >= LIVE_ENTROPY:
            if all(m.end() <= start or m.start() >= end for start, _, end, _ in base):
                found.append((m.start(), 3, m.end(), m[0]))
    return found


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, *_ in spans)


_SPAN = "struct<start:int,kind:int,end:int,hash:binary,random:boolean>"
_SCAN = f"n_assign long, n_access long, n_hex long, base_sha256 string, _spans array<{_SPAN}>"


def scan(docs: DataFrame, *, text: str, keep: dict[str, str]) -> DataFrame:
    """One row per document with its base spans and candidate tokens."""
    kinds = ", ".join(f"`{new}` {docs.schema[old].dataType.simpleString()}" for new, old in keep.items())

    def start():
        ids = row_ids()

        def work(rows):
            out = []
            for row in rows:
                body = row["_text"] or ""
                base = base_spans(body)
                n = Counter(s[1] for s in base)
                spans = [
                    {
                        "start": s, "kind": k, "end": e, "random": entropy(v) >= LIVE_ENTROPY,
                        "hash": hashlib.blake2b(v.encode(), digest_size=16).digest(),
                    }
                    for s, k, e, v in sorted(base + other_tokens(body, base))
                ]
                out.append({c: row[c] for c in keep} | {
                    "_row": next(ids), "n_assign": n[0], "n_access": n[1], "n_hex": n[2],
                    "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "_spans": spans,
                })
            return out

        return work

    rows = docs.select(*[F.col(old).alias(new) for new, old in keep.items()], F.col(text).alias("_text"))
    return map_rows(rows, start, f"_row long, {kinds}, {_SCAN}")


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct repositories and owners per hash.

    Rows are first made distinct per (hash, owner, repository), then counted in
    two steps, each combined before it is shuffled: a value that a third of the
    corpus holds reaches no task as more than one row per owner and task.
    """
    held = spans.groupBy("hash", "_owner", "_repo").agg(F.lit(1).alias("_one"))
    owners = held.groupBy("hash", "_owner").agg(F.count(F.lit(1)).alias("_repos"))
    return owners.groupBy("hash").agg(F.sum("_repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def _listed(spans: Column) -> Column:
    kind = F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    ))
    return F.concat_ws(",", kind)


def find_secrets(
    docs: DataFrame, *, repo: str = "doc_id", owner: str = "source", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: base counts and digest, all spans, and how many are copied or live.

    A document plays a repository and its source the owner unless told otherwise.
    A null text is an empty one; null repositories and null owners count as one
    of each; repeated rows are separate documents of the same repository; other
    columns are not read; an empty table gives an empty one.
    """
    found = written(scan(docs, text=text, keep={"doc_id": doc_id, "_repo": repo, "_owner": owner}), "secret-scan")
    spans = found.where(F.size("_spans") > 0).select("_row", "_repo", "_owner", F.explode("_spans").alias("_span"))
    spans = spans.select("_row", "_repo", "_owner", "_span.*")
    judged = spans.join(ownership(spans), "hash")
    own = (F.col("n_owners") <= OWN_OWNERS) & (F.col("n_repos") <= OWN_REPOS)
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS)
    judged = judged.where((F.col("kind") < 3) | own)
    per_row = judged.groupBy("_row").agg(
        # a document's own spans: never more than its text holds
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("_all"),
        F.count_if(copied).alias("n_copied"),
        F.count_if(own & F.col("random")).alias("n_live"),
    )
    counts = ("n_copied", "n_live")
    return found.join(per_row, "_row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(_listed(F.col("_all")), F.lit("")).alias("spans"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
    )
