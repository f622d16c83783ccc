"""Secret scans whose verdict rests on who holds a value, counted over the whole corpus.

Patterns give base spans (assign, access, hex) and further candidates (long mixed tokens, kind ``live``). A value's hash
is counted over distinct repositories and owners: values that many hold are copied examples; values that few hold look
live. Live-looking further candidates join the spans; base spans always stay.

Edge cases: a null or empty text has no spans. Null is a repository and an owner of its own, apart from the empty name.
Repeated rows give repeated results, and one holder. Values are told apart by 128 bits of SHA-256. Work on a text grows
with its length, however many spans it holds; spans that start together are ordered by kind. Columns of docs other than
the named ones are ignored, those of redact() stay, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from factloom.llm.shared import Scratch, sieve
from factloom.llm.words import release

KINDS = ("assign", "access", "hex", "live")
ASSIGN = re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: From so many distinct owners on, a value is a copied example.
EXAMPLE_OWNERS = 4
#: Tasks among which the rows of one value are dealt.
SALTS = 16


def entropy(s: str) -> float:
    """Bits for each character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by start, then kind. Runs are maximal, so a least length can stand in the pattern of the last two kinds."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def further_spans(text: str, base: list, least_entropy: float = 3.5) -> list[tuple[int, int, int, str]]:
    """Long tokens with digits and letters and much entropy that no base span touches. ``base`` is sorted; both lists are walked once."""
    out, k, reach = [], 0, 0  # reach: the furthest end of the base spans that start before the token ends
    for m in MIXED.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        s = m[0]
        if reach <= m.start() and re.search("[0-9]", s) and re.search("[A-Za-z]", s) and entropy(s) >= least_entropy:
            out.append((m.start(), 3, m.end(), s))
    return out


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


_SCANNED = "_row long, doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int,kind:int,end:int,hash:string>>, repo string, owner string, _key string"


def _scan(batches):
    row = TaskContext.get().partitionId() << 33
    names = [c.split()[0] for c in re.sub("<.*>", "", _SCANNED).split(", ")]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))
    for batch in batches:
        n, counts, digests, found = batch.num_rows, [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            counts.append([sum(s[1] == k for s in base) for k in range(3)])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            found.append([{"start": a, "kind": k, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest()[:32]} for a, k, b, v in sorted(base + further_spans(text, base))])
        cols = [pa.array(range(row, row + n), pa.int64()), batch.column("doc_id"), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(3)], pa.array(digests, pa.string()), pa.array(found, kind), batch.column("repo"), batch.column("owner"), batch.column("_key")]
        row += n
        yield pa.RecordBatch.from_arrays(cols, names)
        release()


def row_key(doc_id, text):
    """128 bits of hash, as text, that tell rows of different ids or texts apart."""
    return F.concat(F.hex(F.xxhash64(doc_id, text)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), text, doc_id)))


def secret_spans(docs: DataFrame, repo_col: str = "source", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """For each row of docs (doc_id, text, repository, owner): the counts, digests and ``spans``.

    ``_key`` is 128 bits of hash of id and text. ``span_list`` has (start, kind, end, owners, repos, live) for each span; ``n_live`` and ``n_example`` count verdicts.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    named = docs.select(F.col("doc_id").cast("long"), "text", F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), row_key(F.col("doc_id"), F.col("text")).alias("_key"))
    rows = scratch.table(named.mapInArrow(_scan, _SCANNED), "scanned")
    each = rows.where(F.size("found") > 0).select("_row", "repo", "owner", F.explode("found").alias("f")).select("_row", "repo", "owner", "f.*")
    # Distinct holders first, so a value in a third of all rows is a row for each task and holder.
    held = each.select("hash", "repo", "owner").distinct()
    count = lambda c: F.count_distinct(F.struct(c))  # a null is one holder
    held = held.groupBy("hash").agg(count("owner").alias("owners"), count("repo").alias("repos"))
    # A value of one holder needs no lookup. The others stand once for each salt, so rows of a common value go to many tasks.
    held = held.where("owners > 1 OR repos > 1").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = each.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(held, ["hash", "_salt"], "left")
    judged = judged.withColumns({c: F.coalesce(c, F.lit(1).cast("long")) for c in ("owners", "repos")}).withColumn("live", F.col("owners") < example_owners)
    judged = judged.where((F.col("kind") < 3) | F.col("live"))
    spans = judged.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repos", "live"))).alias("span_list"))
    out = rows.drop("found", "repo", "owner").join(spans, "_row", "left").drop("_row")
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda live: F.coalesce(F.size(F.filter("span_list", lambda s: s["live"] == live)), F.lit(0)).cast("long")
    out = out.withColumn("span_list", F.coalesce("span_list", F.expr("CAST(array() AS array<struct<start:int,kind:int,end:int,owners:long,repos:long,live:boolean>>)")))
    return out.withColumn("spans", F.array_join(F.transform("span_list", one), ",")).withColumn("n_live", count(True)).withColumn("n_example", count(False))


def redact(docs: DataFrame, mark: str = "[SECRET]", repo_col: str = "source", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """docs, all rows and columns, with live-looking spans replaced by ``mark``; copied examples stay. Overlapping spans are replaced as one.

    Rows meet their spans by a hash of id and text, so ids need not be unique. Only rows that may have live spans are
    shuffled.
    """
    key = row_key(F.col("doc_id"), F.col("text"))
    spans = secret_spans(docs, repo_col, owner_col, example_owners)
    live = spans.where("n_live > 0").select(F.col("_key").alias("_span_key"), F.filter("span_list", lambda s: s["live"]).alias("_spans")).dropDuplicates(["_span_key"])
    live = Scratch(docs.sparkSession, "redact").table(live, "live")

    def cut(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, (text, found) in enumerate(zip(texts, batch.column("_spans").to_pylist(), strict=True)):
                if not found or text is None:
                    continue
                out, at = [], 0
                for s in found:
                    if s["start"] >= at:
                        out += [text[at : s["start"]], mark]
                    at = max(at, s["end"])
                texts[i] = "".join(out) + text[at:]
            keep = [c for c in batch.schema.names if c != "_spans"]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in keep], keep)

    keyed = docs.withColumn("_own_key", key)
    short = live.select(F.xxhash64("_span_key").alias("k"))
    keyed = keyed.withColumn("_maybe", sieve(short, "k")(F.xxhash64("_own_key")))
    clean = keyed.where(~F.col("_maybe")).select(*docs.columns)
    rest = keyed.where("_maybe").join(live, F.col("_own_key") == F.col("_span_key"), "left").select(*docs.columns, "_spans")
    return clean.unionByName(rest.mapInArrow(cut, docs.schema))
