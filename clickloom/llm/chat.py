"""Chat formatting of records in various layouts, with DataFrame functions only.

A record's schema gives the paths of its nested fields; their hash, without
types and order of values, is its fingerprint. Each known fingerprint selects a
mapping, which says declaratively where prompt, instruction and messages stand.
The canonical turns are rendered with a template, whose control strings are
escaped inside texts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that no text may hold unescaped, with what stands for them; the escape itself comes first. (Fixed values.)
ESCAPES = [
    ("\\", "\\\\"), ("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"),
    ("<<SYS>>", "<\\<SYS>>"), ("<</SYS>>", "<\\</SYS>>"),
]
LEARNED_ROLE = "assistant"
#: Turns whose spans are listed together, as each step copies the list.
SPANS = 1000


@dataclass(frozen=True)
class Layout:
    """Where a kind of record has its turns: one list of messages, or single fields in the order of turns."""

    name: str
    paths: tuple[str, ...]
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    #: Names in the records that stand for other roles; all others are roles as they are.
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()


LAYOUTS = [
    Layout("messages", ("messages[].content", "messages[].role"), "$.messages"),
    Layout("turns", ("turns[].role", "turns[].text"), "$.turns", text="text"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), "$.conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))),
    Layout("prompt", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system_prompt", ("prompt", "response", "system"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
]

def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _shape(record: Column) -> Column:
    """A JSON record with "" for every string value: as small as its structure, and with the same fields and types."""
    # An escaped quote or backslash becomes a delete character, so that quotes only stand at the ends of strings.
    plain = F.regexp_replace(record, r'\\[\\"]', "\x7f")
    return F.regexp_replace(plain, r'"([^"]*+)"(\s*+:)|"[^"]*+"', '"$1"$2')


def fingerprint(record: Column, strict: bool = False) -> Column:
    """The hash of a JSON record's nested field paths, lists as ``[]``; null if it is no object.

    A record that cannot be read gives null as well, or an error if ``strict``.
    Its texts play no part and may be of any length.
    """
    value = F.parse_json(_shape(record)) if strict else F.try_parse_json(_shape(record))
    top = F.map_entries(F.try_variant_get(value, "$", "map<string, variant>"))

    def below(entry: Column) -> Column:
        # The fields of the first object of a list name its element's; further ones may leave some out, not add others.
        inner = F.flatten(F.transform(
            F.coalesce(F.try_variant_get(entry["value"], "$", "array<map<string, variant>>"), F.array()),
            lambda item: F.map_keys(item)))
        nested = F.transform(F.array_distinct(inner), lambda key: F.concat(entry["key"], F.lit("[]."), key))
        objects = F.transform(
            F.map_keys(F.coalesce(F.try_variant_get(entry["value"], "$", "map<string, variant>"), F.expr("cast(map() as map<string, variant>)"))),
            lambda key: F.concat(entry["key"], F.lit("."), key))
        found = F.concat(nested, objects)
        return F.when(F.size(found) > 0, found).otherwise(F.array(entry["key"]))

    paths = F.array_sort(F.flatten(F.transform(top, below)))
    return F.when(paths.isNotNull(), F.sha2(F.concat_ws("\n", paths), 256))


def canonical(records: DataFrame, layouts: list[Layout] = LAYOUTS, strict: bool = False) -> DataFrame:
    """(conv_id, layout, turns) of JSON records (conv_id, record); turns are (role, text).

    A record whose fingerprint no layout has gets a null layout and null turns,
    as does one that cannot be read, unless ``strict`` makes it an error. The
    texts of a record may be of any length.
    """
    known = records.select("conv_id", "record", fingerprint(F.col("record"), strict).alias("fingerprint"))
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "maxStringLen": str(2**31 - 1)}

    def turn(role: Column, text: Column) -> Column:
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def message(layout: Layout):
        def found(m: Column) -> Column:
            role = m[layout.role]
            for name, stands_for in layout.roles:
                role = F.when(m[layout.role] == name, stands_for).otherwise(role)
            return turn(role, m[layout.text])

        return found

    name = turns = None
    for layout in layouts:
        if layout.messages:
            field = layout.messages.removeprefix("$.")
            value = F.from_json("record", f"`{field}` array<struct<`{layout.role}`: string, `{layout.text}`: string>>", options)
            found = F.transform(value[field], message(layout))
        else:
            value = F.from_json("record", ", ".join([*(f"`{field}` string" for _, field in layout.fields), "_bad string"]), options)
            found = F.when(value["_bad"].isNull(), F.array(*[turn(F.lit(role), value[field]) for role, field in layout.fields]))
        mine = F.col("fingerprint") == layout.fingerprint
        name = F.when(mine, layout.name) if name is None else name.when(mine, layout.name)
        turns = F.when(mine, found) if turns is None else turns.when(mine, found)
    found = known.select("conv_id", name.alias("layout"), turns.alias("turns"))
    return found.withColumn("layout", F.when(F.col("turns").isNotNull(), F.col("layout")))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of canonical turns (conv_id, turns).

    ``loss`` marks what a model learns, as starts and lengths (in code points)
    of the assistant texts within ``formatted``. Line ends in a role are escaped.
    """
    def one(t: Column) -> Column:
        role = F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n"))
        head = F.concat(F.lit(OPEN), role, F.lit(MIDDLE))
        text = escape(t["text"])
        return F.struct(F.concat(head, text, F.lit(CLOSE)).alias("all"), F.char_length(head).cast("bigint").alias("head"),
                        F.char_length(text).cast("bigint").alias("size"), (t["role"] == LEARNED_ROLE).alias("learned"))

    pieces = turns.select("conv_id", F.transform("turns", one).alias("p"))
    # The running start of each turn, carried along the list.
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start: bigint, size: bigint>>)").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        span = F.struct((state["at"] + x["head"]).alias("start"), x["size"].alias("size"))
        return F.struct((state["at"] + F.char_length(x["all"])).alias("at"), F.concat(state["spans"], F.filter(F.array(span), lambda _: x["learned"])).alias("spans"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / SPANS)), lambda i: F.slice("p", (i * SPANS + 1).cast("int"), F.lit(SPANS)))
    lists = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<array<struct<start: bigint, size: bigint>>>)").alias("lists"))

    def block(state: Column, some: Column) -> Column:
        begin = F.struct(state["at"].alias("at"), start["spans"].alias("spans"))
        return F.aggregate(some, begin, step, lambda end: F.struct(end["at"].alias("at"), F.concat(state["lists"], F.array(end["spans"])).alias("lists")))

    loss = F.when(F.col("p").isNotNull(), F.flatten(F.aggregate(blocks, lists, block)["lists"]))
    return pieces.select("conv_id", F.concat_ws("", F.transform("p", lambda x: x["all"])).alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, learned) parsed from (conv_id, formatted, loss): the turns, and the unescaped texts under the mask."""
    parts = F.split("formatted", OPEN.replace("|", r"\|"))
    parts = F.slice(parts, F.lit(2), F.size(parts))

    def one(part: Column) -> Column:
        body = F.substring(part, F.lit(1), F.char_length(part) - len(CLOSE))
        role = F.regexp_extract(body, r"(?s)^((?:[^\\\n]|\\.)*+)\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(body, F.char_length(role) + 2, F.char_length(body))).alias("text"))

    texts = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["size"].cast("int"))))
    return formatted.select("conv_id", "formatted", F.transform(parts, one).alias("turns"), texts.alias("learned"))


def records(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): the rows (conv_id, turn, role, text) of each conversation, by turn, as one JSON record of messages.

    Text and role that are null are empty. A conversation is one row, so its
    rows meet in one task; rows with equal turns are ordered by role and text.
    Rows without conv_id are one conversation without id.
    """
    item = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    listed = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    messages = F.transform("items", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return listed.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def formatted_digests(raw: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """Format records (conv_id, record) and describe what reading the output back gives.

    Per record: conv_id, n_turns, turns_sha256 (of role, line end, text, line
    end of each turn), loss_chars and loss_sha256 (of all text under the mask,
    unescaped) and formatted_chars. A null record or one of no known layout has
    nulls for all but conv_id; one that is no JSON is an
    error. An empty list of messages has no fields and so no known layout. An
    empty table gives none.
    """
    back = read_back(render(canonical(raw, layouts, strict=True)))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learned = F.concat_ws("", "learned")
    known = F.col("learned").isNotNull()
    return back.select(
        "conv_id", F.when(known, F.size("turns").cast("bigint")).alias("n_turns"), F.when(known, F.sha2(whole, 256)).alias("turns_sha256"),
        F.when(known, F.char_length(learned).cast("bigint")).alias("loss_chars"), F.when(known, F.sha2(learned, 256)).alias("loss_sha256"),
        F.when(known, F.char_length("formatted").cast("bigint")).alias("formatted_chars"))
