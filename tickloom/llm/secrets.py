r"""Secret scans: candidate credentials, told apart by who owns copies of them.

Candidates are matches of a few patterns. A value that many repositories or
owners hold is an example that was copied around; one that a single owner
holds looks live. Both are known only from the whole corpus, so candidate
hashes are counted by distinct repository and owner before any verdict.

Positions come from built-in functions: ``split`` by a pattern gives the
pieces between its matches and ``regexp_extract_all`` the matches, so running
lengths of both give every match's place in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import Scratch, ascii_lower, row_key, same_row

#: Kind, pattern, group that holds the value, least length of that group, fragments of which a text with a match
#: has one. ``assign`` is matched on the folded text (folding keeps every position); the others on the text itself. The first
#: three are the base kinds, in the order of the listing; ``issued`` adds credentials with the prefixes of well-known issuers.
KINDS = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", 2, 12, ("passw", "secret", "token", "api")),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, ("AKIA",)),
    ("hex", r"[0-9a-f]+", 0, 16, ()),
    ("issued", r"(?:gh[opsu]_|glpat-|xox[abp]-|sk_live_|AIza)[A-Za-z0-9_-]+", 0, 24, ("gh", "glpat-", "xox", "sk_live_", "AIza")),
)
BASE = ("assign", "access", "hex")
#: Runs of ``hex`` below the least length are most of its matches; this equals matching and then dropping them, because a run
#: of a greedy single class is never entered a second time.
FAST = {"hex": r"[0-9a-f]{16,}"}

#: A value in at least this many repositories, or with at least this many owners, is a copied example.
EXAMPLE_REPOS, EXAMPLE_OWNERS = 5, 2


def _matches(text: Column, folded: Column, kind: tuple) -> Column:
    """Array of (kind, start, end, value) of one kind, in order; empty where the text has none."""
    name, pattern, group, least, parts = kind
    pattern = FAST.get(name, pattern)
    place = folded if name == "assign" else text
    found = F.regexp_extract_all(place, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(place, F.lit(pattern), F.lit(group)) if group else found
    pieces = F.split(place, pattern, -1)
    # (end of the match before, spans so far)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("spans"))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["piece"])
        end = start + F.length(m["found"])
        # the value stands at the end of the match; it is taken from the text, whose case the folded one has lost
        value = F.substring(text, end - F.length(m["value"]) + 1, F.length(m["value"]))
        span = F.struct(F.lit(name).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(m["value"]) >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("found"), values.alias("value"))
    spans = F.aggregate(zipped, begin, step, lambda state: state["spans"])
    may = F.lit(False)
    for part in parts:
        may = may | place.contains(part)
    if not parts:
        may = F.regexp_like(place, F.lit(pattern))
    return F.when(may, spans).otherwise(begin["spans"])


def candidates(docs: DataFrame) -> DataFrame:
    """Spans of all kinds per row: doc_id, row_key, spans (array of kind, start, end, value; by start, then kind as listed)."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", "_repo", "_owner", row_key(F.col("text")).alias("row_key"), text.alias("text"), ascii_lower(text).alias("folded"))
    parts = [_matches(F.col("text"), F.col("folded"), kind) for kind in KINDS]
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k[0]), F.lit(i))])
    keyed = F.transform(
        F.concat(*parts),
        lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")),
    )
    return base.select("doc_id", "row_key", "_repo", "_owner", F.array_sort(keyed).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of every value (digest); each step combines before its shuffle, so a value that
    stands in a third of all rows is a few rows per task."""
    each = found.select(F.explode("spans.value").alias("value"), "_repo", "_owner").select(F.sha2("value", 256).alias("digest"), "_repo", "_owner")
    pairs = each.groupBy("digest", "_owner", "_repo").agg(F.count("*").alias("n"))
    by_repo = pairs.groupBy("digest", "_repo").agg(F.sum("n").alias("n"))
    repos = by_repo.groupBy("digest").agg(F.count("_repo").alias("n_repos"), F.sum("n").alias("n_found"))
    owners = pairs.groupBy("digest", "_owner").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("_owner").alias("n_owners"))
    return repos.join(owners, "digest")


def scan(
    docs: DataFrame, repo: str = "doc_id", owner: str = "source",
    example_repos: int = EXAMPLE_REPOS, example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text, and the columns named by ``repo`` and ``owner``).

    Returns doc_id, row_key, spans (array of start, end, kind, live), one row
    per input row. ``live`` is false for values of at least ``example_repos``
    distinct repositories and ``example_owners`` distinct owners.

    Null texts count as empty and have no spans. Null repositories and owners
    count as none. Repeated rows give repeated results; a repeated row is the
    same repository. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.keep(candidates(docs.select("doc_id", "text", F.col(repo).alias("_repo"), F.col(owner).alias("_owner"))), "found")
    with_spans = found.where(F.size("spans") > 0)
    # stored, so that the join below reads both sides through exchanges that Spark may split where one value is hot
    owned = scratch.keep(ownership(with_spans), "owned")
    each = with_spans.select("doc_id", "row_key", F.explode("spans").alias("s")).withColumn("digest", F.sha2("s.value", 256))
    judged = each.join(owned, "digest").select(
        "doc_id", "row_key", "s",
        (~((F.col("n_repos") >= example_repos) & (F.col("n_owners") >= example_owners))).alias("live"),
    )
    # one row's spans are bounded by its text; copies of a row hold equal spans, which the set makes one
    spans = judged.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.struct("s.start", "s.rank", "s.end", "s.kind", "live"))).alias("spans"))
    out = same_row(found.select("doc_id", "row_key"), spans)
    return out.select("doc_id", "row_key", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    """The contract's columns: counts of the base kinds, their digest, all spans as text, and live spans."""
    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(condition) -> Column:
        return F.size(F.filter("spans", condition)).cast("long")

    def of(kind: str) -> Column:
        return count(lambda s: s["kind"] == kind).alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scanned.select(
        "doc_id", *map(of, BASE),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count(lambda s: s["live"]).alias("n_live"),
    )


def redact(docs: DataFrame, mark: str = "<secret>", **how) -> DataFrame:
    """``docs`` with every live-looking span replaced by ``mark`` and ``n_chars`` counted anew; all rows and columns stay.

    Overlapping spans (a value may match two patterns) are replaced once.
    """
    live = scan(docs, **how).select("doc_id", "row_key", F.filter("spans", lambda s: s["live"]).alias("live")).where(F.size("live") > 0).dropDuplicates(["doc_id", "row_key"])
    # other columns travel in a struct, so that none can clash
    keyed = docs.select("doc_id", row_key(F.col("text")).alias("row_key"), F.col("text").alias("_text"), F.struct(*docs.columns).alias("_row"))
    joined = same_row(keyed, live.withColumnRenamed("live", "_live"))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = F.substring(F.col("_text"), state["at"] + 1, s["start"] - state["at"])
        apart = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(state["out"], between, F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    cleaned = F.aggregate("_live", begin, step, lambda state: F.concat(state["out"], F.substring(F.col("_text"), state["at"] + 1, F.length("_text"))))
    done = joined.select("_row", "_live", F.when(F.col("_live").isNull(), F.col("_text")).otherwise(cleaned).alias("_new"))
    put = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col("_live").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[put.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
