"""Chat formatting by schema fingerprints, in DataFrame functions alone.

A record comes in any of the known layouts, as JSON or as typed columns. The nested field paths that it has are hashed; the hash
selects, from a table of all combinations of the paths that layouts ask for, a declarative mapping to canonical turns. Turns are then
written in a marked template with a loss mask.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import fresh

START, END = "<|im_start|>", "<|im_end|>"
#: Stands for a line feed inside a role; no text or role has "<|" once escaped.
ROLE_LF = "<|lf|>"
#: A record of no more characters is within the limits of the JSON parser.
MOST_CHARS = 20_000_000
TURN, TURNS = "struct<role:string,text:string>", "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping to turns. each: (field with a list, its field for the role, for the text), and roles, the names that change; or turns: (role, fields whose
    texts are joined by an empty line). A turn of optional fields alone is left out where none is there; before ``each`` comes a system turn if there is one."""

    name: str
    each: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def required(self) -> tuple[str, ...]:
        """Paths without which a record isn't of this layout."""
        if self.each:
            return tuple(f"{self.each[0]}[].{x}" for x in self.each[1:])
        return tuple(f for _, fields in self.turns for f in fields if f not in self.optional)


_SYSTEM = ("system", ("system",))
LAYOUTS = (
    Layout("messages", each=("messages", "role", "content")),
    Layout("conversations", each=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}, turns=(_SYSTEM,), optional=("system",)),
    Layout("instruction", turns=(_SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("prompt_response", turns=(_SYSTEM, ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("prompt_completion", turns=(_SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("question_answer", turns=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
)
PATHS = sorted({p for x in LAYOUTS for p in x.required})


def layout_table(spark: SparkSession) -> DataFrame:
    """(fp, layout, fault): for each combination of the paths that layouts ask for, by its fingerprint, the layout that it has whole; several or none are a
    fault. A fixed table of 2 ** len(PATHS) rows."""
    rows = []
    for n in range(len(PATHS) + 1):
        for found in combinations(PATHS, n):
            whole = [x.name for x in LAYOUTS if set(x.required) <= set(found)]
            rows.append((",".join(found), whole[0] if len(whole) == 1 else None, None if len(whole) == 1 else f"several layouts: {', '.join(whole)}" if whole else f"no known layout: {', '.join(found) or 'none of its fields'}"))
    return spark.createDataFrame(rows, "paths string, layout string, fault string").select(F.xxhash64("paths").alias("fp"), "layout", "fault")


class JsonSource:
    """Fields of a variant."""

    def __init__(self, v: str):
        self.v = v

    def _at(self, name: str, kind: str) -> Column:
        return F.try_variant_get(F.col(self.v), f"$.{name}", kind)

    def has(self, path: str) -> Column:
        """Whether the path is anywhere in the record: in any of a list's elements, not only the first."""
        name, _, inner = path.partition("[].")
        kind = F.schema_of_variant(self._at(name, "variant"))
        return F.coalesce(kind.rlike(rf"^ARRAY<OBJECT<(.*, )?{inner}: ") if inner else ~kind.isin("VOID"), F.lit(False))

    def text(self, name: str) -> Column:
        return _flat(self._at(name, "variant"))

    def pairs(self, name: str, role: str, text: str) -> Column:
        return F.transform(self._at(name, f"array<struct<`{role}`:string,`{text}`:variant>>"), lambda m: F.struct(m[role].alias("role"), _flat(m[text]).alias("text")))

    def odd(self, layout: Layout) -> Column:
        """Whether a text of the layout is neither a text nor a list of parts with texts."""
        if layout.each:
            return F.exists(self._at(layout.each[0], f"array<struct<`{layout.each[2]}`:variant>>"), lambda m: _odd(m[layout.each[2]]))
        return reduce(Column.__or__, [F.coalesce(_odd(self._at(f, "variant")), F.lit(False)) for _, fields in layout.turns for f in fields])


def _parts(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _part(p: Column) -> Column:
    return F.coalesce(F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.try_variant_get(p, "$.text", "string"))


def _flat(v: Column) -> Column:
    """The text of a variant: itself, or the texts of its typed parts in a row."""
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(F.transform(_parts(v), lambda p: F.coalesce(_part(p), F.lit(""))), "")).otherwise(F.try_variant_get(v, "$", "string"))


def _odd(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.coalesce(F.when(kind.startswith("ARRAY"), F.exists(_parts(v), lambda p: _part(p).isNull())).otherwise(kind.startswith("OBJECT")), F.lit(False))


class TypedSource:
    """Fields of typed columns; a null one isn't there."""

    def __init__(self, columns: dict[str, str]):
        self.columns = columns

    def has(self, path: str) -> Column:
        name = path.partition("[].")[0]
        return F.col(self.columns[name]).isNotNull() if name in self.columns else F.lit(False)

    def text(self, name: str) -> Column:
        return F.col(self.columns[name]) if name in self.columns else F.lit(None).cast("string")

    def pairs(self, name: str, role: str, text: str) -> Column:
        return F.transform(F.col(self.columns[name]), lambda m: F.struct(m[role].alias("role"), m[text].alias("text"))) if name in self.columns else F.lit(None).cast(TURNS)

    def odd(self, layout: Layout) -> Column:
        return F.lit(False)


def _turns(layout: Layout, source: JsonSource | TypedSource) -> Column:
    """The mapping as an expression. Null roles and texts become empty."""
    parts = []
    for role, fields in layout.turns:
        must = [f for f in fields if f not in layout.optional]
        texts = [source.text(f) if f in must else F.nullif(source.text(f), F.lit("")) if must else source.text(f) for f in fields]
        turn = F.array(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *texts).alias("text")))
        parts.append(turn if must else F.when(F.coalesce(*texts).isNotNull(), turn).otherwise(F.array().cast(TURNS)))
    if layout.each:
        def named(role: Column) -> Column:
            return reduce(lambda c, x: F.when(role == x[0], F.lit(x[1])).otherwise(c), layout.roles.items(), role)

        parts.append(F.transform(source.pairs(*layout.each), lambda m: F.struct(named(m["role"]).alias("role"), m["text"].alias("text"))))
    clean = lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    return F.transform(F.concat(*parts), clean)


def fingerprint(source: JsonSource | TypedSource) -> Column:
    """Hash of those nested field paths, in order, of all that layouts ask for, that the record has."""
    return F.xxhash64(F.array_join(F.array_compact(F.array(*[F.when(source.has(p), F.lit(p)) for p in PATHS])), ","))


def _mapped(df: DataFrame, source: JsonSource | TypedSource, broken: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and layout, turns and error, which take other names where those are used."""
    fp, found, fault, layout, turns, error = fresh(df, "__fp", "__layout", "__fault", "layout", "turns", "error")
    table = layout_table(df.sparkSession).select(F.col("fp").alias(fp), F.col("layout").alias(found), F.col("fault").alias(fault))
    chosen = df.withColumn(fp, fingerprint(source)).join(F.broadcast(table), fp, "left")
    whole, odd = F.lit(None).cast(TURNS), F.lit(False)
    for x in reversed(LAYOUTS):
        hit = F.col(found) == x.name
        whole, odd = F.when(hit, _turns(x, source)).otherwise(whole), F.when(hit, source.odd(x)).otherwise(odd)
    says = F.when(broken, F.lit("not a record")).when(F.col(found).isNull(), F.col(fault)).when(odd, F.lit("parts without text"))
    return chosen.select(*[F.col(f"`{c}`") for c in keep], F.when(~broken, F.col(found)).alias(layout), F.coalesce(F.when(~broken, whole), F.array().cast(TURNS)).alias(turns), says.alias(error))


def canonical_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """Every row and column, and three last ones: ``layout``, ``turns`` (array<struct<role,text>>) and ``error`` (with underscores where the input has those).

    A record that is null, broken, of no known layout or of several has no layout and no turns, and its error says so; so does that of a record whose
    content has parts without a text (an image, say), which count as empty. Null roles and texts become empty; a content that is a list of parts is
    their texts in a row; fields that no layout asks for are ignored. Repeated rows stay; an empty table gives an empty table.

    The parser takes texts of up to MOST_CHARS characters and records of up to 128 MiB. A longer record that doesn't parse may be whole, so it raises
    an error. ``typed_turns`` has no such limits."""
    (name,) = fresh(records, "__v")
    v = F.try_parse_json(F.col(f"`{record_col}`"))
    size = F.char_length(F.col(f"`{record_col}`"))
    error = F.raise_error(F.concat(F.lit("A record doesn't parse and may be too large to: characters "), size.cast("string")))
    seen = records.withColumn(name, F.when(v.isNull() & (size > MOST_CHARS), error.cast("variant")).otherwise(v))
    return _mapped(seen, JsonSource(name), F.coalesce(~F.schema_of_variant(F.col(name)).startswith("OBJECT"), F.lit(True)), records.columns)


def typed_turns(records: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """As ``canonical_turns``, for records in typed columns: the layouts' fields by name (or ``fields``: column by field); a null column is a field that isn't
    there. So a text or a conversation may be as large as a value in Spark."""
    known = {f for x in LAYOUTS for f in ([x.each[0]] if x.each else []) + [f for _, fs in x.turns for f in fs]}
    columns = fields or {c: c for c in records.columns if c in known}
    return _mapped(records, TypedSource(columns), F.lit(False), records.columns)


def escape(c: Column) -> Column:
    r"""One more backslash into every "<", backslashes, "|": afterwards no "<|" is left. Undone by ``unescape``."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def format_turns(df: DataFrame, learn: tuple[str, ...] = ("assistant",), turns_col: str = "turns") -> DataFrame:
    """Every row and column, and two last ones: ``formatted`` and ``loss_spans`` (array<struct<start,chars>>, code points from 0), with underscores where the
    input has those.

    A span covers the escaped text of one turn whose role is in ``learn``. No turns give an empty string; null turns count as none; very long texts are
    written whole; repeated rows stay; an empty table gives an empty table."""
    parts_, formatted, loss = fresh(df, "__parts", "formatted", "loss_spans")
    turns = F.coalesce(F.col(f"`{turns_col}`"), F.array().cast(TURNS))
    parts = F.transform(turns, lambda t: F.struct(t["role"].isin(*learn).alias("on"), F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(ROLE_LF)), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    spans = f"""aggregate(`{parts_}`, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,chars:bigint>>)), (a, p) -> named_struct(
        'at', a.at + char_length(p.head) + char_length(p.body) + {len(END) + 1},
        'spans', if(p.on, array_append(a.spans, named_struct('start', a.at + char_length(p.head), 'chars', cast(char_length(p.body) as bigint))), a.spans)), a -> a.spans)"""
    written = F.array_join(F.transform(parts_, lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return df.withColumn(parts_, parts).select(*[F.col(f"`{c}`") for c in df.columns], written.alias(formatted), F.expr(spans).alias(loss))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role,text>>."""
    at = lambda p: F.locate("\n", p)
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")
    role = lambda p: unescape(F.replace(F.substr(p, F.lit(len(START) + 1), F.instr(p, F.lit("\n")) - len(START) - 1), F.lit(ROLE_LF), F.lit("\n")))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), unescape(F.substr(p, F.instr(p, F.lit("\n")) + 1)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span, joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")


def _messages_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, messages): array<struct<role,content>>, rows in order of turn, role, text; null roles and texts are empty."""
    rows = conversations.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")).alias("__t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("__t")).alias("__ts"))
    return turns.select("conv_id", F.transform("__ts", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): one JSON record in the messages layout per conversation; rows in order of turn, role, text.

    Rows without conv_id form a conversation of their own; repeated rows stay repeated turns; null roles and texts are empty; an empty table gives an
    empty table; other columns aren't read."""
    return _messages_of(conversations).select("conv_id", F.to_json(F.struct("messages")).alias("record"))


def typed_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, and the fields of all layouts): each conversation in one of the six layouts, in turn by conv_id, where it fits; else as messages.

    A user and an assistant turn, with or without a system turn before them, fit the layouts that have fields for them (no system turn fits questions and
    answers); other names of roles keep a conversation from the layout that renames them. Defined cases as for ``records_of``."""
    rows = _messages_of(conversations)
    roles = F.transform("messages", lambda m: m["role"])
    led = F.coalesce(F.get(roles, F.lit(0)) == "system", F.lit(False))
    pair = F.when(led, F.slice(roles, 2, F.greatest(F.size(roles) - 1, F.lit(0)))).otherwise(roles) == F.array(F.lit("user"), F.lit("assistant"))
    k = F.coalesce(F.pmod("conv_id", F.lit(len(LAYOUTS))), F.lit(0))
    renamed = F.arrays_overlap(roles, F.array(*[F.lit(x) for x in LAYOUTS[1].roles]))
    kind = F.when((k == 1) & ~renamed, LAYOUTS[1].name)
    for n, x in enumerate(LAYOUTS[2:], 2):
        kind = kind.when((k == n) & pair & (F.lit("system" in x.optional) | ~led), x.name)
    rows = rows.withColumn("kind", kind.otherwise(LAYOUTS[0].name))
    text = lambda n: F.get("messages", (F.lit(n) + led.cast("int")).cast("int"))["content"]
    back = {v: k for k, v in LAYOUTS[1].roles.items()}
    turned = F.transform("messages", lambda m: F.struct(reduce(lambda c, x: F.when(m["role"] == x[0], F.lit(x[1])).otherwise(c), back.items(), m["role"]).alias("from"), m["content"].alias("value")))
    fields = {"messages": F.when(F.col("kind") == "messages", F.col("messages")), "conversations": F.when(F.col("kind") == "conversations", turned)}
    simple = [x for x in LAYOUTS if not x.each]
    fields["system"] = F.when(led & F.col("kind").isin(*[x.name for x in simple if "system" in x.optional]), text(-1))
    for n, role in enumerate(("user", "assistant")):
        for f in dict.fromkeys(f for x in simple for r, fs in x.turns for f in fs if r == role and f not in x.optional):
            fields[f] = F.when(F.col("kind").isin(*[x.name for x in simple if f in x.required]), text(n))
    return rows.select("conv_id", *[c.alias(f) for f, c in fields.items()])


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, layout, turns, error) of a table of turns, by way of typed records in all layouts."""
    return typed_turns(typed_records(conversations)).select("conv_id", "layout", "turns", "error")
