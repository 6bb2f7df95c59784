"""Secret scans by multipart credential linking, in DataFrame functions alone.

Base spans are found by three patterns; each is a secret or an identifier by itself.  The method adds weak
candidates, which are reported only where complementary parts stand within `scope` code points:
  weak_secret  short values of secret-like keys, and bare 40-character tokens: with an identifier or an endpoint;
  identifier   user, client or account names: with a secret, base or weak;
  endpoint     addresses of services: with an identifier and a secret.
Weak secrets and identifiers that overlap a base span are that span; an endpoint may hold one, and both are reported.

Positions come from split() and regexp_extract_all() on the same pattern.  The interval join is an equi-join on
(document, cell), cells as wide as the scope: parts are first reduced to the least and greatest start per document, cell and
role, so that a candidate meets a bounded number of rows however many parts stand near it, and no
text is shuffled.

Null texts are empty; empty texts have no spans; rows that repeat doc_id and text get the same spans each; spans of one start come in the
order of their kinds (then of their ends); empty tables give empty results; extra columns are ignored, whatever their names; texts are read
whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

# fixed values: the base patterns
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ of 32 or more
# patterns of the weak parts
WEAK = r"""(?i)\b(pass|pwd|pw|passphrase|private_?key|auth|credential|signature)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
SHORT = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BARE = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
IDENTIFIER = r"""(?i)\b(user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})"""
ENDPOINT = r"""(?i)(?:\b[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+|\b(?:host|hostname|endpoint|server|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,})"""

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "weak_secret", "identifier", "endpoint")
RUN = 256
SPAN = "struct<start:long,rank:int,kind:string,end:long>"


def _spans(text: Column, pattern: str, kind: str, least: int = 0, most: int = 0, group: int = 0) -> Column:
    """The leftmost non-overlapping matches whose group is of `least` characters or more (and of `most` or fewer)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    if group:
        parts = F.arrays_zip(whole.alias("m"), F.slice(gaps, 1, F.size(whole)).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))
    else:
        parts = F.arrays_zip(whole.alias("m"), F.slice(gaps, 1, F.size(whole)).alias("g"), whole.alias("v"))

    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.cast("long").alias("end"))
        size = F.length(x["v"])
        keeps = (size >= least) if not most else (size >= least) & (size <= most)
        return F.struct(end.cast("long").alias("at"), F.when(keeps, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def after(acc: Column, x: Column) -> Column:
        moved = F.transform(x["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    # places are sums of lengths, over runs of matches first and then over runs, so that no long array grows match by match
    empty = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(RUN)), lambda b: F.aggregate(F.slice(parts, b, RUN), empty, step))
    found = F.aggregate(runs, empty, after, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def scan(docs: DataFrame, scope: int = 300) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of every row of docs(doc_id, text).  Spans are
    kind:start:end in code points, end exclusive, by start, then kind."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("uid"),
        _spans(F.col("text"), ASSIGN, "assign", 8, group=2).alias("assign"),
        _spans(F.col("text"), ACCESS, "access", 16).alias("access"),
        _spans(F.col("text"), HEX, "hex", 32).alias("hex"),
        F.concat(_spans(F.col("text"), WEAK, "weak_secret", 6, group=2), _spans(F.col("text"), SHORT, "weak_secret", 4, 7, group=2), _spans(F.col("text"), BARE, "weak_secret", 40)).alias("weak"),
        _spans(F.col("text"), IDENTIFIER, "identifier", 3, group=2).alias("identifier"),
        _spans(F.col("text"), ENDPOINT, "endpoint", 3).alias("endpoint"),
    )
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    apart = lambda c: F.filter(c, lambda w: ~F.exists(F.col("base"), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    rows = cut(rows.select("doc_id", "uid", "assign", "access", "hex", apart(F.array_distinct("weak")).alias("weak"), apart(F.col("identifier")).alias("identifier"), "endpoint"))

    # documents that hold parts of two roles or more, of which one can be reported (an endpoint needs both others), each once
    parts = rows.where("(size(weak) + size(identifier) > 0 or (size(access) > 0 and size(endpoint) > 0)) and size(weak) + size(assign) > 0 and size(identifier) + size(access) + size(endpoint) > 0").dropDuplicates(["uid"])
    role = lambda c, name: F.transform(c, lambda s: F.struct(F.lit(name).alias("role"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    parts = parts.select("uid", F.explode(F.concat(role(F.concat("assign", "weak"), "secret"), role(F.concat("access", "identifier"), "identifier"), role(F.col("endpoint"), "endpoint"))).alias("p")).select("uid", "p.*")
    cell = lambda c: F.floor(c / scope).cast("long")
    near = parts.groupBy("uid", "role", cell(F.col("start")).alias("cell")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = parts.where(F.col("kind").isin("weak_secret", "identifier", "endpoint"))
    weak = weak.withColumn("cell", F.explode(F.sequence(cell(F.greatest(F.col("start") - scope, F.lit(0))), cell(F.col("end") + scope))))
    weak = weak.select("uid", "cell", "kind", "start", "end")
    met = weak.join(near, ["uid", "cell"]).where((F.col("first") <= F.col("end") + scope) & (F.col("last") >= F.col("start") - scope))
    has = lambda name: F.max(F.when(F.col("role") == name, 1).otherwise(0)) == 1
    met = met.groupBy("uid", "kind", "start", "end").agg(has("secret").alias("secret"), has("identifier").alias("id"), has("endpoint").alias("at"))
    linked = met.where("(kind = 'weak_secret' and (id or at)) or (kind = 'identifier' and secret) or (kind = 'endpoint' and id and secret)")
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    linked = linked.groupBy("uid").agg(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end").cast(SPAN)).alias("linked"))

    none = F.array().cast(f"array<{SPAN}>")
    base = F.concat("assign", "access", "hex")
    more = F.coalesce("linked", none)
    return rows.join(linked, "uid", "left").select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, more)).alias("spans"),
        F.size(more).cast("long").alias("n_linked"),
    )
