"""Chats as one schema, mapped to and from the message shapes of three kinds of model servers, as VARIANT.

A chat is a list of messages; a message has a role, parts and, for a tool's answer, call_id and name. A part is text, an image (url,
detail), a call of a tool (call_id, name, text: its arguments), or reasoning. The shapes:

* `responses`: parts input_text, input_image, function_call, reasoning;
* `completions`: parts text and image_url, calls in tool_calls, reasoning in reasoning_details;
* `blocks`: parts text, image (by url or base64), tool_use, tool_result, thinking; system messages stand beside the list.

Content that is one text stays plain text in all of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.replies import elements, is_kind

PART = "struct<kind:string,text:string,url:string,detail:string,call_id:string,name:string>"
MESSAGE = f"struct<role:string,parts:array<{PART}>,call_id:string,name:string>"
CHAT = f"array<{MESSAGE}>"
_DATA_URL = r"^data:([^;,]+);base64,(.*)$"


def part(kind: str, text: Column | None = None, url: Column | None = None, detail: Column | None = None, call_id: Column | None = None, name: Column | None = None) -> Column:
    values = {"kind": F.lit(kind), "text": text, "url": url, "detail": detail, "call_id": call_id, "name": name}
    return F.struct(*((F.lit(None) if v is None else v).cast("string").alias(k) for k, v in values.items()))


def message(role: str | Column, *parts: Column, call_id: Column | None = None, name: Column | None = None) -> Column:
    who = F.lit(role) if isinstance(role, str) else role
    both = ((F.lit(None) if v is None else v).cast("string").alias(k) for k, v in (("call_id", call_id), ("name", name)))
    return F.struct(who.alias("role"), F.array(*parts).alias("parts"), *both)


def said(role: str | Column, text: Column) -> Column:
    return message(role, part("text", text))


def user_with_images(text: Column, urls: Column) -> Column:
    """A user's message of a text and images (a list of urls; null ones, which could not be read, are left out)."""
    shown = F.transform(F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: u.isNotNull()), lambda u: part("image", url=u, detail=F.lit("auto")))
    none = F.lit(None).cast("string")
    return F.struct(F.lit("user").alias("role"), F.concat(F.array(part("text", text)), shown).alias("parts"), none.alias("call_id"), none.alias("name"))


def tool_answer(call_id: Column, text: Column, name: Column | None = None) -> Column:
    return message("tool", part("text", text), call_id=call_id, name=name)


def texts(m: Column, between: str = " ") -> Column:
    """The text parts of a message, joined."""
    return F.array_join(F.transform(F.filter(m["parts"], lambda p: p["kind"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), between)


def as_text(chat: Column) -> Column:
    """A line with the role and the text, for every message."""
    return F.array_join(F.transform(chat, lambda m: F.concat(m["role"], F.lit(":\n"), texts(m))), "\n")


def without_system(chat: Column) -> Column:
    return F.filter(chat, lambda m: m["role"] != "system")


def first_of(chat: Column, role: str) -> Column:
    """The first text of the first message of a role; null if there is none."""
    own = F.try_element_at(F.filter(chat, lambda m: m["role"] == role), F.lit(1))
    return F.try_element_at(F.filter(own["parts"], lambda p: p["kind"] == "text"), F.lit(1))["text"]


# Out


def _json(*fields: Column) -> Column:
    """An object without its null fields."""
    return F.parse_json(F.to_json(F.struct(*fields)))


def _lit(value: str, name: str) -> Column:
    return F.lit(value).alias(name)


def _plain(m: Column) -> Column:
    return (F.size(m["parts"]) == 1) & (m["parts"][0]["kind"] == "text")


def _content(m: Column, one) -> Column:
    """The message's content: its text where that is all, else a list of its parts."""
    return F.when(_plain(m), m["parts"][0]["text"].cast("variant")).otherwise(F.parse_json(F.concat(F.lit("["), F.array_join(F.transform(m["parts"], lambda p: F.to_json(one(p))), ","), F.lit("]"))))


def to_responses(chat: Column) -> Column:
    """A VARIANT list of messages with input_text and input_image parts."""
    def one(p):
        k = p["kind"]
        return (
            F.when(k == "text", _json(_lit("input_text", "type"), p["text"].alias("text")))
            .when(k == "image", _json(_lit("input_image", "type"), p["url"].alias("image_url"), p["detail"].alias("detail")))
            .when(k == "call", _json(_lit("function_call", "type"), p["call_id"].alias("call_id"), p["name"].alias("name"), p["text"].alias("arguments")))
            .otherwise(_json(_lit("reasoning", "type"), F.array(F.struct(_lit("summary_text", "type"), p["text"].alias("text"))).alias("summary")))
        )

    return _list(F.transform(chat, lambda m: _json(m["role"].alias("role"), _content(m, one).alias("content"), m["call_id"].alias("tool_call_id"), m["name"].alias("name"))))


def to_completions(chat: Column) -> Column:
    """A VARIANT list of messages with text and image_url parts; calls of tools and reasoning stand beside the content."""
    def one(p):
        shown = F.struct(p["url"].alias("url"), F.coalesce(p["detail"], F.lit("auto")).alias("detail"))
        return F.when(p["kind"] == "text", _json(_lit("text", "type"), p["text"].alias("text"))).otherwise(_json(_lit("image_url", "type"), shown.alias("image_url")))

    def full(m):
        def beside(kind, make):
            own = F.filter(m["parts"], lambda p: p["kind"] == kind)
            return F.when(F.size(own) > 0, F.transform(own, make))

        calls = beside("call", lambda p: F.struct(p["call_id"].alias("id"), _lit("function", "type"), F.struct(p["name"].alias("name"), p["text"].alias("arguments")).alias("function")))
        thoughts = beside("reasoning", lambda p: F.struct(_lit("reasoning.text", "type"), p["text"].alias("text")))
        left = F.struct(m["role"].alias("role"), F.filter(m["parts"], lambda p: p["kind"].isin("text", "image")).alias("parts"))
        return _json(m["role"].alias("role"), _content(left, one).alias("content"), calls.alias("tool_calls"), thoughts.alias("reasoning_details"), m["call_id"].alias("tool_call_id"), m["name"].alias("name"))

    return _list(F.transform(chat, full))


def to_blocks(chat: Column) -> Column:
    """A VARIANT object of `system` (the system messages' texts) and `messages`, whose content is blocks; a tool's answer is the user's tool_result."""
    def one(p):
        k = p["kind"]
        data = F.struct(_lit("base64", "type"), F.regexp_extract(p["url"], _DATA_URL, 1).alias("media_type"), F.regexp_extract(p["url"], _DATA_URL, 2).alias("data"))
        return (
            F.when(k == "text", _json(_lit("text", "type"), p["text"].alias("text")))
            .when((k == "image") & p["url"].rlike(_DATA_URL), _json(_lit("image", "type"), data.alias("source")))
            .when(k == "image", _json(_lit("image", "type"), F.struct(_lit("url", "type"), p["url"].alias("url")).alias("source")))
            .when(k == "call", _json(_lit("tool_use", "type"), p["call_id"].alias("id"), p["name"].alias("name"), F.try_parse_json(p["text"]).alias("input")))
            .otherwise(_json(_lit("thinking", "type"), p["text"].alias("thinking")))
        )

    def full(m):
        answer = F.array(F.struct(_lit("tool_result", "type"), m["call_id"].alias("tool_use_id"), texts(m).alias("content")))
        return F.when(m["role"] == "tool", _json(_lit("user", "role"), answer.alias("content"))).otherwise(_json(m["role"].alias("role"), _content(m, one).alias("content")))

    system = F.filter(chat, lambda m: m["role"] == "system")
    joined = F.when(F.size(system) > 0, F.array_join(F.transform(system, lambda m: texts(m)), "\n"))
    return _json(joined.alias("system"), _list(F.transform(without_system(chat), full)).alias("messages"))


def _list(items: Column) -> Column:
    return F.parse_json(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.to_json(x)), ","), F.lit("]")))


# In


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _parts(content: Column, one) -> Column:
    """The parts of a content that is a text, a list of parts (read by one), or nothing."""
    listed = F.transform(elements(content), one)
    return F.when(is_kind(content, "STRING"), F.array(part("text", _get(content, "$")))).otherwise(F.coalesce(listed, F.array().cast(f"array<{PART}>")))


def _message(v: Column, role: Column, parts: Column, call_id: Column) -> Column:
    return F.struct(role.alias("role"), parts.cast(f"array<{PART}>").alias("parts"), call_id.alias("call_id"), _get(v, "$.name").alias("name"))


def from_responses(messages: Column) -> Column:
    """A chat from a VARIANT list of messages in the `responses` shape; null where it is no list."""
    def one(p):
        k = _get(p, "$.type")
        return (
            F.when(k.isin("input_text", "output_text"), part("text", _get(p, "$.text")))
            .when(k == "input_image", part("image", url=_get(p, "$.image_url"), detail=_get(p, "$.detail")))
            .when(k == "function_call", part("call", _get(p, "$.arguments"), call_id=_get(p, "$.call_id"), name=_get(p, "$.name")))
            .otherwise(part("reasoning", _get(p, "$.summary[0].text")))
        )

    return F.transform(elements(messages), lambda m: _message(m, _get(m, "$.role"), _parts(F.try_variant_get(m, "$.content", "variant"), one), _get(m, "$.tool_call_id")))


def from_completions(messages: Column) -> Column:
    """A chat from a VARIANT list of messages in the `completions` shape: reasoning first, then content, then calls."""
    def one(p):
        return F.when(_get(p, "$.type") == "text", part("text", _get(p, "$.text"))).otherwise(part("image", url=_get(p, "$.image_url.url"), detail=_get(p, "$.image_url.detail")))

    def full(m):
        none = F.array().cast(f"array<{PART}>")
        thoughts = F.transform(elements(m, "$.reasoning_details"), lambda r: part("reasoning", F.coalesce(_get(r, "$.text"), _get(r, "$.summary"), _get(r, "$.data"))))
        calls = F.transform(elements(m, "$.tool_calls"), lambda c: part("call", _get(c, "$.function.arguments"), call_id=_get(c, "$.id"), name=_get(c, "$.function.name")))
        parts = F.concat(F.coalesce(thoughts, none), _parts(F.try_variant_get(m, "$.content", "variant"), one), F.coalesce(calls, none))
        return _message(m, _get(m, "$.role"), parts, _get(m, "$.tool_call_id"))

    return F.transform(elements(messages), full)


def from_blocks(body: Column) -> Column:
    """A chat from a VARIANT object in the `blocks` shape: its system text first, if it has one; tool_result blocks are tools' answers."""
    def one(p):
        k = _get(p, "$.type")
        data = F.concat(F.lit("data:"), _get(p, "$.source.media_type"), F.lit(";base64,"), _get(p, "$.source.data"))
        return (
            F.when(k == "text", part("text", _get(p, "$.text")))
            .when(k == "image", part("image", url=F.coalesce(_get(p, "$.source.url"), data), detail=F.lit("auto")))
            .when(k == "tool_use", part("call", F.to_json(F.try_variant_get(p, "$.input", "variant")), call_id=_get(p, "$.id"), name=_get(p, "$.name")))
            .when(k == "tool_result", part("text", _get(p, "$.content")))
            .otherwise(part("reasoning", _get(p, "$.thinking")))
        )

    def full(m):
        answer = _get(m, "$.content[0].tool_use_id")
        return _message(m, F.when(answer.isNotNull(), "tool").otherwise(_get(m, "$.role")), _parts(F.try_variant_get(m, "$.content", "variant"), one), answer)

    system = F.when(_get(body, "$.system").isNotNull(), F.array(said("system", _get(body, "$.system")))).otherwise(F.array().cast(CHAT))
    return F.concat(system, F.transform(elements(body, "$.messages"), full))


# Answers

#: How a server says that an answer ended, and the word for it here.
_ENDED = {"completed": "stop", "incomplete": "length", "failed": "error", "cancelled": "error"}


def unified(answer: Column) -> Column:
    """A server's answer (VARIANT) as one schema: id, model, created, choices of content, finish_reason, reasoning (VARIANT list), error.

    Answers with `choices` are taken as they are; those with `output` give a choice for each message, with the reasoning before it and
    the ending's word translated (an unknown one is an error)."""
    kind = "array<struct<content:string,finish_reason:string,reasoning:array<struct<kind:string,text:string>>>>"
    output = elements(answer, "$.output")

    def thought(r):
        t = _get(r, "$.type")
        return F.struct(t.alias("kind"), F.when(t == "reasoning.summary", _get(r, "$.summary")).when(t == "reasoning.text", _get(r, "$.text")).when(t == "reasoning.encrypted", _get(r, "$.data")).alias("text"))

    def choice(c):
        finish = F.coalesce(F.nullif(_get(c, "$.finish_reason"), F.lit("")), _get(c, "$.native_finish_reason"))
        return F.struct(_get(c, "$.message.content").alias("content"), finish.alias("finish_reason"), F.transform(elements(c, "$.message.reasoning_details"), thought).alias("reasoning"))

    def spoken(o, i):
        before = F.filter(F.slice(output, F.lit(1), i), lambda r: (_get(r, "$.type") == "reasoning") & _get(r, "$.summary[0].text").isNotNull())
        text = F.try_element_at(F.filter(elements(o, "$.content"), lambda p: _get(p, "$.type") == "output_text"), F.lit(1))
        thoughts = F.transform(before, lambda r: F.struct(F.lit("reasoning.text").alias("kind"), _get(r, "$.summary[0].text").alias("text")))
        ended = F.coalesce(F.create_map(*(F.lit(x) for pair in _ENDED.items() for x in pair))[_get(o, "$.status")], F.lit("error"))
        return F.struct(_get(o, "$.type").alias("t"), F.coalesce(_get(text, "$.text"), F.lit("")).alias("content"), ended.alias("finish_reason"), F.when(F.size(thoughts) > 0, thoughts).alias("reasoning"))

    messages = F.transform(F.filter(F.transform(output, spoken), lambda x: x["t"] == "message"), lambda x: F.struct(x["content"].alias("content"), x["finish_reason"].alias("finish_reason"), x["reasoning"].alias("reasoning")))
    choices = F.coalesce(F.transform(elements(answer, "$.choices"), choice).cast(kind), messages.cast(kind), F.array().cast(kind))
    created = F.coalesce(F.try_variant_get(answer, "$.created", "bigint"), F.try_variant_get(answer, "$.created_at", "bigint"))
    return F.struct(_get(answer, "$.id").alias("id"), _get(answer, "$.model").alias("model"), created.alias("created"), choices.alias("choices"), F.to_json(F.try_variant_get(answer, "$.error", "variant")).alias("error"))


def first_response(answer: Column) -> Column:
    """The first choice's content; null without one. answer: unified()."""
    return F.try_element_at(answer["choices"], F.lit(1))["content"]


def reasoning_content(answer: Column) -> Column:
    """The first choice's first reasoning, whatever its kind."""
    return F.try_element_at(F.try_element_at(answer["choices"], F.lit(1))["reasoning"], F.lit(1))["text"]


def finish_reason(answer: Column) -> Column:
    return F.try_element_at(answer["choices"], F.lit(1))["finish_reason"]
