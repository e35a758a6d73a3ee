"""Replies of language models, read tolerantly: VARIANT parsing with repairs, proposals, cluster representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRINGS = r'"(\\.|[^"\\])*"'


def stripped(text: str | Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unfenced(raw: str | Column, marker: str = "json") -> Column:
    """What stands between a leading fence of the marker and the last fence; a reply without one as a whole."""
    text = stripped(raw)
    after = F.substring(text, len(marker) + 4, 1 << 30)
    closed = F.regexp_extract(after, r"(?s)^(.*)```", 1)
    return F.when(text.startswith(f"```{marker}"), stripped(F.when(F.contains(after, F.lit("```")), closed).otherwise(after))).otherwise(text)


def parsed(text: str | Column) -> Column:
    """The text as VARIANT; null if it cannot be repaired.

    Tried in turn: as it is, without commas before a closing bracket, with the brackets closed that are open at the end, both."""
    text = F.col(text) if isinstance(text, str) else text
    trailing = F.regexp_replace(text, r",\s*([}\]])", "$1")
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(trailing), F.try_parse_json(_closed(text)), F.try_parse_json(_closed(trailing)))


def _closed(text: Column) -> Column:
    """The text with an open string and open brackets closed, innermost first, and a comma at the end dropped."""
    cut = F.concat(F.regexp_replace(text, r"[,\s]+$", ""), F.when(F.regexp_count(F.regexp_replace(text, _STRINGS, ""), F.lit('"')) % 2 == 1, F.lit('"')).otherwise(F.lit("")))
    marks = F.split(F.regexp_replace(F.regexp_replace(cut, _STRINGS, ""), r"[^\[\]{}]", ""), "")
    open_ = F.aggregate(
        marks, F.lit(""), lambda held, m: F.when(m.isin("[", "{"), F.concat(held, m)).when(m.isin("]", "}"), F.substring(held, F.lit(1), F.greatest(F.length(held) - 1, F.lit(0)))).otherwise(held)
    )
    return F.concat(cut, F.translate(F.reverse(open_), "[{", "]}"))


def is_kind(v: Column, kind: str) -> Column:
    """Whether a VARIANT is an OBJECT, an ARRAY, a STRING, ..; null is none."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def elements(v: Column, path: str = "$") -> Column:
    """The elements of the list at a path; null where there is no list."""
    return F.when(is_kind(F.try_variant_get(v, path, "variant"), "ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def _as_text(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def without_repeats(texts: Column, blocked: Column) -> Column:
    """Texts that are not empty, in no block list, and not met before; case and outer white space do not matter."""
    fold = lambda x: F.lower(stripped(x))
    avoid = F.transform(blocked, fold)
    fresh = F.filter(F.transform(texts, stripped), lambda x: (x != "") & ~F.array_contains(avoid, fold(x)))
    return F.filter(fresh, lambda x, i: F.array_position(F.transform(fresh, fold), fold(x)) == i + 1)


def proposals(replies: DataFrame, n: int) -> DataFrame:
    """replies with proposals (at most n) and reasoning. replies: raw, blocked (a list; null: none), ..

    The widest {..} is read as an object whose `proposals` is a list; items that are not text count by their text, null items not. Without
    such an object or list every quoted string of five characters or more is a proposal. A null reply has none."""
    v = parsed(F.nullif(F.regexp_extract("raw", r"(?s)\{.*\}", 0), F.lit("")))
    listed = F.transform(F.filter(elements(v, "$.proposals"), lambda x: ~F.is_variant_null(x)), _as_text)
    quoted = F.regexp_extract_all("raw", F.lit('"([^"]{5,})"'), 1)
    blocked = F.coalesce("blocked", F.array().cast("array<string>"))
    found = F.coalesce(without_repeats(F.coalesce(listed, quoted), blocked), F.array().cast("array<string>"))
    return replies.withColumns({"proposals": F.slice(found, 1, n), "reasoning": F.when(is_kind(v, "OBJECT"), F.try_variant_get(v, "$.reasoning", "string"))})


def joined_proposals(replies: DataFrame, n: int, by: list[str], order: str) -> DataFrame:
    """by.., pos, attr: the proposals of a group's replies in order; one that an earlier reply made is not made again. n of each reply at most."""
    each = proposals(replies, n).select(*by, order, F.posexplode("proposals").alias("at", "attr"))
    first = each.groupBy(*by, F.lower(F.col("attr")).alias("_f")).agg(F.min_by("attr", F.struct(order, "at")).alias("attr"), F.min(F.struct(order, "at")).alias("_p"))
    rows = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_p", "attr"))).alias("z"))
    return rows.select(*by, F.posexplode(F.col("z.attr")).alias("pos", "attr"))


def representatives(replies: DataFrame, n_pop: int) -> DataFrame:
    """replies with representatives: one attribute for each of the n_pop largest clusters. replies: raw, attributes (a list), ..

    A reply is a list of {representative: {index, attribute}, members: [..]}; a list in a list is unwrapped, what is no object is left out. Clusters go by
    size, then as they come. An index outside the attributes falls back on the representative's own text; one without either is left out. No more
    attributes than n_pop stay as they are; a null reply, one that is no list or holds no object gives the first n_pop."""
    v = parsed(unfenced("raw"))
    outer = elements(v)
    inner = F.when(is_kind(F.try_element_at(outer, F.lit(1)), "ARRAY"), elements(F.try_element_at(outer, F.lit(1)))).otherwise(outer)
    clusters = F.filter(inner, lambda c: is_kind(c, "OBJECT"))

    def read(c, i):
        index = F.when(F.schema_of_variant(F.try_variant_get(c, "$.representative.index", "variant")) == "BIGINT", F.try_variant_get(c, "$.representative.index", "bigint"))
        inside = (index >= 0) & (index < F.size("attributes"))
        text = F.when(inside, F.try_element_at(F.col("attributes"), (index + 1).cast("int"))).otherwise(F.try_variant_get(c, "$.representative.attribute", "string"))
        return F.struct((-F.greatest(F.size(elements(c, "$.members")), F.lit(0))).alias("size"), i.alias("at"), F.coalesce(text, F.lit("")).alias("attr"))

    ranked = F.slice(F.array_sort(F.transform(clusters, read)), 1, n_pop)
    named = F.filter(F.transform(ranked, lambda r: r["attr"]), lambda a: a != "")
    first = F.slice("attributes", 1, n_pop)
    plain = (F.size("attributes") <= n_pop) | (F.coalesce(F.size(clusters), F.lit(0)) <= 0)
    return replies.withColumn("representatives", F.when(plain, first).otherwise(named))
