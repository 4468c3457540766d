"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base spans come from three patterns; each match is found with its place by splitting the text at the
matches.  Bare credential-like tokens (20 or more characters with lower case, upper case and digits;
padding and dot-joined segments belong to them) are further candidates, alone or after ``NAME=``.  The hash of every candidate value is counted over distinct documents
(repositories) and distinct sources (owners).  A value that many owners or many documents hold is a
copied example; a value in few documents of few owners is live.  Live bare tokens become spans of kind ``owned``; base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import identified
from evalweave.plans.shared import cut

# The patterns of the three base kinds and their least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 12
ACCESS = "(AKIA[A-Z0-9]{14,})"  # whole runs of capitals and digits: 18 characters with AKIA
HEX = "([0-9a-f]{16,})"
# Own values: what counts as a bare token, and from how many owners (or documents) on a value is a copied example.
# A bare token is a run of segments joined by single dots, one of them of 20 characters or more, with its '=' padding.
# A name before '=' is none, nor is the host and path of an address with dots; the loops are possessive, so none backtracks.
SEGMENT = "[A-Za-z0-9+/_-]"
TOKEN = (f"(?<!{SEGMENT})(?<!{SEGMENT}[.])(?!(?<=:)//[A-Za-z0-9_-]++[.])(?=[A-Za-z0-9+/_.-]*?{SEGMENT}{{20}})"
         f"({SEGMENT}++(?:[.]{SEGMENT}++)*+(?:=++(?![\"']?{SEGMENT}))?+)(?!=)")
EXAMPLE_OWNERS = 3
EXAMPLE_DOCUMENTS = 20  # or from how many distinct documents on, whatever the owners
KINDS = ("assign", "access", "hex", "owned")
SALTS = 16
MASK = "[SECRET]"
SPAN = "array<struct<start:int,kind:int,stop:int,value:int,hash:bigint>>"


def _found(text: Column, kind: int, pattern: str, keep) -> Column:
    """Spans of one kind: start, kind, stop, start of the value (code points), hash of the value."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        stop = begin + F.length(part["hit"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"),
                        (stop - F.length(part["value"])).alias("value"), F.xxhash64(part["value"]).alias("hash"))
        return F.struct(stop.alias("at"), F.when(keep(part["value"]), F.concat(state["spans"], F.array(span))).otherwise(
            state["spans"]).alias("spans"))

    parts = F.zip_with(F.arrays_zip(hits.alias("hit"), values.alias("value")), F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(
        h["hit"].alias("hit"), h["value"].alias("value"), g.alias("gap")))
    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda s: s["spans"])).otherwise(F.array().cast(SPAN))


def with_spans(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Add all candidate spans of a text, ordered by start and kind; bare tokens inside base spans are left out."""
    source = F.coalesce(F.col(text), F.lit(""))
    everything = lambda v: F.lit(True)
    base, bare = f"{out}_base", f"{out}_bare"
    found = docs.withColumns({
        base: F.concat(
            _found(source, 0, ASSIGN, lambda v: F.length(v) >= ASSIGN_VALUE),
            _found(source, 1, ACCESS, everything), _found(source, 2, HEX, everything)),
        bare: _found(source, 3, TOKEN, lambda v: v.rlike(SEGMENT + "{20}") & v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")),
    })
    own = F.filter(bare, lambda t: ~F.exists(base, lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    return found.withColumn(out, F.array_sort(F.concat(F.col(base), own))).drop(base, bare)


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash: distinct documents, distinct owners and whether it is live, for rows (spans, id, owner).

    NULL ids count as one document, NULL owners as one owner.  Counts combine before every shuffle and
    no step holds the documents of one hash.
    """
    each = found.select("id", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    distinct = lambda c: F.count_distinct(F.struct(c))  # noqa: E731  the struct of a NULL counts
    live = (F.col("owners") < EXAMPLE_OWNERS) & (F.col("documents") < EXAMPLE_DOCUMENTS)
    return each.groupBy("hash").agg(distinct("id").alias("documents"), distinct("owner").alias("owners")).withColumn("live", live)


def _judged(found: DataFrame) -> DataFrame:
    """(row, spans): the spans of each row with candidates, each with its verdict ``live``."""
    verdict = ownership(found).select("hash", "live", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    each = found.select("row", F.explode("spans").alias("span")).select(
        "row", "span", F.col("span.hash").alias("hash"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    live = each.join(verdict, ["hash", "salt"]).select("row", F.struct(
        "span.start", "span.kind", "span.stop", "span.value", "live").alias("span"))
    return live.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))  # the spans of one document


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """(doc_id, spans): every document with its spans (start, kind number, stop, value, live), in order.

    Offsets are code points, stop exclusive.  NULL and empty texts have no spans; repeated rows give
    repeated rows; base spans are there whatever the verdict, bare tokens only when live.
    """
    found = _candidates(docs, doc_id, text, owner)
    judged = _judged(found.where(F.size("spans") > 0))
    kept = F.filter("spans", lambda s: (s["kind"] < 3) | s["live"])
    dirty = found.where(F.size("spans") > 0).select("row", "id").join(judged, "row").select(F.col("id").alias(doc_id), kept.alias("spans"))
    clean = found.where(F.size("spans") == 0).select(F.col("id").alias(doc_id))
    return dirty.unionByName(clean, allowMissingColumns=True).withColumn(
        "spans", F.coalesce("spans", F.array().cast(dirty.schema["spans"].dataType)))


def _candidates(docs: DataFrame, doc_id: str, text: str, owner: str) -> DataFrame:
    named = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(owner).alias("owner"))
    return cut(with_spans(identified(named, "row"), "text", "spans").drop("text"))


def listed(spans: Column) -> Column:
    """kind:start:stop of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def _masked(text: Column, spans: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        before = F.when(span["value"] >= state["at"], F.concat(
            F.substring(text, state["at"] + 1, span["value"] - state["at"]), F.lit(MASK))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], span["stop"]).alias("at"), F.concat(state["out"], before).alias("out"))

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"])))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The documents with every live secret value replaced by a mark; all rows and columns stay.

    Copied examples stay readable.  ``n_chars``, where present, follows the new text of changed rows.
    """
    row = "_row_identity_of_secret_scan"
    marked = cut(with_spans(identified(docs, row), text, "_spans_of_secret_scan"))
    dirty = marked.where(F.size("_spans_of_secret_scan") > 0)
    judged = _judged(dirty.select(F.col(row).alias("row"), F.col(doc_id).alias("id"), F.col(owner).alias("owner"), F.col("_spans_of_secret_scan").alias("spans")))
    live = F.array_sort(F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["value"].alias("value"), s["stop"].alias("stop"))))
    values = judged.select(F.col("row").alias(row), live.alias("_live_of_secret_scan"))
    joined = dirty.join(values, row, "left")
    hit = F.coalesce(F.size("_live_of_secret_scan"), F.lit(0)) > 0
    changed = joined.withColumn("_hit_of_secret_scan", hit).withColumn(
        text, F.when(F.col("_hit_of_secret_scan"), _masked(F.col(text), F.col("_live_of_secret_scan"))).otherwise(F.col(text)))
    if n_chars in docs.columns:
        changed = changed.withColumn(n_chars, F.when(F.col("_hit_of_secret_scan"), F.length(text)).otherwise(
            F.col(n_chars)).cast(docs.schema[n_chars].dataType))
    return marked.where(F.size("_spans_of_secret_scan") == 0).select(docs.columns).unionByName(
        changed.select(docs.columns))
