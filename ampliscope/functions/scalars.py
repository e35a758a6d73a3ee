"""Scalar functions as columns: keys, slugs, verdict parsing, templates, costs, chat histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_key(**fields: Column) -> Column:
    """SHA-1 of the JSON of the fields in name order."""
    return F.sha1(F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items())))))


def text_key(*parts: str | Column, n: int = 16) -> Column:
    """The first n hex digits of SHA-256 over the parts, joined by newlines."""
    return F.substring(F.sha2(F.concat_ws("\n", *map(_c, parts)), 256), 1, n)


def image_id(prompt: str | Column, index: str | Column) -> Column:
    return F.concat(F.substring(F.md5(_c(prompt).cast("binary")), 1, 10), F.lit("_"), F.format_string("%02d", _c(index)))


def short_hash(x: str | Column, n: int = 12, kind: str = "md5") -> Column:
    return F.substring((F.md5 if kind == "md5" else F.sha1)(_c(x).cast("binary")), 1, n)


def slug(x: str | Column) -> Column:
    """Lower case, runs of other characters as one underscore, at most 80 characters; 'attribute' if nothing is left."""
    s = F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "_")
    s = F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, 80)
    return F.when(s == "", "attribute").otherwise(s)


def path_of(*parts: str | Column) -> Column:
    return F.concat_ws("/", *map(_c, parts))


def resolved(path: str | Column, root: str) -> Column:
    return F.when(_c(path).startswith("/"), _c(path)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), _c(path)))


def step_and_topic(name: str | Column) -> tuple[Column, Column]:
    found = lambda i: F.regexp_extract(_c(name), r"step(\d+)_topic(\d+)", i)
    return F.when(found(1) != "", found(1).cast("int")), F.when(found(2) != "", found(2).cast("int"))


def image_of_path(path: str | Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(_c(path), "/"), -1), r"^baseline_|\.[A-Za-z]+$", "")


def plain(x: str | Column) -> Column:
    """White space runs as one space, trimmed, without a final dot."""
    return F.regexp_replace(F.trim(F.regexp_replace(_c(x), r"\s+", " ")), r"\.$", "")


def edit_instruction(mode: str | Column, attr: str | Column) -> Column:
    """An instruction to remove or correct an attribute; another mode is an error."""
    a = plain(attr)
    return (
        F.when(_c(mode) == "remove", F.concat(F.lit("Edit the image so that this is no longer true: "), a, F.lit(".")))
        .when(_c(mode) == "correct", F.concat(F.lit("Keep everything else and correct this: "), a, F.lit(".")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown mode "), _c(mode))))
    )


def verdict(reply: str | Column) -> Column:
    """1, 0 or -1 from a reply that holds a JSON object with applicable and present; 0 where none parses."""
    found = F.from_json(F.regexp_extract(_c(reply), r"(?s)\{.*\}", 0), "applicable boolean, present boolean")
    return F.when(found["applicable"] == F.lit(False), -1).when(found["present"], 1).otherwise(0)


def fenced_json(reply: str | Column) -> Column:
    """The text of the reply's fenced block, or the reply itself, trimmed."""
    block = F.regexp_extract(_c(reply), r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.regexp_replace(F.when(block != "", block).otherwise(_c(reply)), r"^\s+|\s+$", "")


def quoted_proposals(reply: str | Column, most: int) -> Column:
    """Distinct quoted strings of five characters or more, in order, at most `most`."""
    return F.slice(F.array_distinct(F.regexp_extract_all(_c(reply), F.lit(r'"([^"]{5,})"'), F.lit(1))), 1, most)


def yes_no(x: str | Column) -> Column:
    t = F.upper(F.trim(_c(x)))
    return F.when(t.startswith("YES"), "YES").when(t.startswith("NO"), "NO").otherwise("UNKNOWN")


def passes_human(x: str | Column) -> Column:
    """No reply passes; a reply passes if it begins with YES."""
    return _c(x).isNull() | F.upper(F.trim(_c(x))).startswith("YES")


def image_tokens(width: str | Column, height: str | Column, base: int = 85, tile: int = 170) -> Column:
    """Tiles of 512 after fitting into 2048 squared and the shorter side into 768."""
    w, h = _c(width).cast("double"), _c(height).cast("double")
    fit = F.least(F.lit(1.0), 2048 / F.greatest(w, h))
    w, h = w * fit, h * fit
    fit = F.least(F.lit(1.0), 768 / F.least(w, h))
    return (base + tile * F.ceil(F.round(w * fit / 512, 9)) * F.ceil(F.round(h * fit / 512, 9))).cast("long")


def call_cost(tokens_in: str | Column, tokens_out: str | Column, price_in: float, price_out: float) -> Column:
    return (_c(tokens_in) * price_in + _c(tokens_out) * price_out) / 1e6


def model_key(model: str | Column, detail: str | Column) -> Column:
    return F.concat_ws("::", _c(model), _c(detail))


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd-HHmmss")


def dataset_of(path: str | Column) -> Column:
    return F.element_at(F.split(_c(path), "/"), -4)


def summary_or_default(x: str | Column) -> Column:
    return F.coalesce(F.nullif(F.trim(_c(x)), F.lit("")), F.lit("general visual content"))


def number(x: str | Column) -> Column:
    return _c(x).try_cast("double")


def label_text(g: str | Column) -> Column:
    return F.when(_c(g) == 1, "present").when(_c(g) == 0, "absent").when(_c(g) == -1, "N/A").otherwise("FAIL")


def kind_of_model(name: str | Column) -> Column:
    n = F.lower(_c(name))
    return F.when(n.contains("flux"), "flux").when(n.contains("stable-diffusion-3") | n.contains("sd3"), "sd3").otherwise("auto")


# Chat histories: ARRAY<STRUCT<turn, role, text>> in turn order.


def history(turn: str = "turn", role: str = "role", text: str = "text") -> Column:
    """An aggregate: the conversation's messages in turn order."""
    return F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))))


def without_system(messages: str | Column) -> Column:
    return F.filter(_c(messages), lambda m: m["role"] != "system")


def first_of(messages: str | Column, role: str) -> Column:
    return F.try_element_at(F.filter(_c(messages), lambda m: m["role"] == role), F.lit(1))["text"]


def rendered(messages: str | Column) -> Column:
    return F.array_join(F.transform(_c(messages), lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["text"])), "\n")


def added(messages: str | Column, role: str, text: str | Column) -> Column:
    """The history with one more message; its turn follows the last."""
    m = _c(messages)
    turn = F.coalesce(F.array_max(F.transform(m, lambda x: x["turn"])), F.lit(-1)) + 1
    return F.concat(m, F.array(F.struct(turn.cast("long").alias("turn"), F.lit(role).alias("role"), _c(text).alias("text"))))


def request_body(model: str | Column, messages: str | Column, **options: Column) -> Column:
    """A request's JSON; null options are left out."""
    body = F.transform(_c(messages), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return F.to_json(F.struct(_c(model).alias("model"), body.alias("messages"), *(v.alias(k) for k, v in options.items())))


def reply_text(response: str | Column) -> Column:
    return F.get_json_object(_c(response), "$.choices[0].message.content")


def finish_reason(response: str | Column) -> Column:
    r = _c(response)
    return F.coalesce(F.get_json_object(r, "$.choices[0].finish_reason"), F.get_json_object(r, "$.choices[0].native_finish_reason"))


def data_url(content: str | Column, mime: str | Column) -> Column:
    return F.concat(F.lit("data:"), _c(mime), F.lit(";base64,"), F.regexp_replace(F.base64(_c(content)), "[\r\n]", ""))


def byte_chunks(rows: DataFrame, by: str, order: str, size: str, cap: int) -> DataFrame:
    """by, order, chunk: rows are filled into chunks in order, and the next begins where one more row would pass cap bytes.

    A row of more than cap bytes is a chunk alone. A group, the lines of one request file, is one task; only its sizes go there."""

    def fill(frame):
        frame = frame.sort_values(order)
        chunk, full, out = -1, cap, []
        for n in frame[size].tolist():
            chunk, full = (chunk, full + n) if chunk >= 0 and full + n <= cap else (chunk + 1, n)
            out.append(chunk)
        return frame[[by, order]].assign(chunk=out)

    kinds = dict(rows.dtypes)
    return rows.select(by, order, size).groupBy(by).applyInPandas(fill, f"{by} {kinds[by]}, {order} {kinds[order]}, chunk long")



def wrapped(text: str | Column, width: int) -> Column:
    """Lines of whole words of at most `width` characters, as an array; a longer word is cut."""
    words = F.flatten(F.transform(F.split(F.trim(_c(text)), r"\s+"), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(w) - 1) / width).cast("int"))), lambda i: F.substring(w, i * width + 1, F.lit(width)))))
    none = F.array().cast("array<string>")

    def put(lines: Column, w: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        fits = last.isNotNull() & (F.length(last) + 1 + F.length(w) <= width)
        return F.when(fits, F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, w)))).otherwise(F.concat(lines, F.array(w)))

    return F.aggregate(F.filter(words, lambda w: w != ""), none, put)
