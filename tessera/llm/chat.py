"""Conversations in any of several layouts, as one text a turn with a mask of what is learnt.

A record is a JSON object. Its layout is told by a fingerprint: the 64-bit digest of its nested field paths, sorted, without
types and without paths that no layout has. The fingerprint selects a declarative mapping (`Layout`), which names where roles and texts
are; so prompts with responses, instructions with inputs and outputs, lists of messages and single turns become the same canonical turns.

A turn is written `### role: text</turn>` and a line feed. In texts and roles a backslash is doubled, `#` is written `\\h` and `<` `\\l`, in roles
also `:` `\\c`, so no text has a mark of the template or a part of one, wherever it is cut, and reading the escapes gives the text back. The texts of
the learnt roles are under the loss mask, the marks never. A conversation's turns stay rows of their own, in order of their place:
its text is what they say one after the other, however long. Reading back goes through these rows as a stream and holds one at a time.

Cases: a null text or role is empty; a null place comes first; turns at one place are ordered by what they say; a null id is one conversation.
Repeated rows are turns each. A record that is null, no object or has no known layout gives no turns; `layouts` counts them. Texts may be of
any length that a row can hold. Only the named columns take part.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame

from .common import named, of_texts

#: Roles whose texts are learnt.
LEARNT = ("assistant",)
#: How characters that marks of the template have are written in texts, the backslash first, and the last one in roles only.
ESCAPES = (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
#: Names that layouts with senders use for roles.
SENDERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


class Layout(NamedTuple):
    """How records of one layout give turns.

    each: the field that has the list of turns, whose objects have `role` and `text`; or, without it, turns: roles and the fields that
    make their texts, parted by an empty line; or, with neither, the record is a turn itself, at `place`. optional: fields that may be missing. names: other names of roles.
    """

    name: str
    each: str | None = None
    role: str | None = None
    text: str | None = None
    place: str | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    names: tuple[tuple[str, str], ...] = ()

    def paths(self) -> tuple[str, ...]:
        if self.each:
            return f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"
        return tuple(f for _, fields in self.turns for f in fields) or (self.place, self.role, self.text)

    def named(self, role: object) -> str:
        return dict(self.names).get(_text(role), _text(role))

    def of(self, record: dict) -> list[tuple[int | None, str, str]]:
        """The record's turns: place, role, text."""
        if self.each:
            return [(k, self.named(x.get(self.role)), _text(x.get(self.text))) for k, x in enumerate(record[self.each])]
        if self.turns:
            said = [(role, [_text(record[f]) for f in fields if record.get(f) is not None]) for role, fields in self.turns if any(f in record for f in fields)]
            return [(k, role, "\n\n".join(x for x in texts if x or len(texts) == 1)) for k, (role, texts) in enumerate(said)]
        return [(record.get(self.place), self.named(record.get(self.role)), _text(record.get(self.text)))]


LAYOUTS = (
    Layout("messages", each="messages", role="role", text="content"),
    Layout("shared", each="conversations", role="from", text="value", names=SENDERS),
    Layout("prompt", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("completion", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("turn", place="turn", role="role", text="text"),
)


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def paths_of(value: object, path: str = "") -> Iterator[str]:
    """Field paths of a nested value, `a.b` for fields and `a[]` for what lists hold; a list or object without content is its own path."""
    inner: Iterable[tuple[str, object]] = ()
    if isinstance(value, dict):
        inner = ((f"{path}.{k}" if path else k, v) for k, v in value.items())
    elif isinstance(value, list):
        inner = ((f"{path}[]", v) for v in value)
    some = False
    for deeper, v in inner:
        some = True
        yield from paths_of(v, deeper)
    if not some and path:
        yield path


def fingerprint(paths: Iterable[str]) -> int:
    """64 bits of a set of paths, as a signed long."""
    h = xxhash.xxh64_intdigest("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _by_fingerprint(layouts: Sequence[Layout]) -> tuple[dict[int, Layout], set[str]]:
    """Layouts by the fingerprints of what they may have, and the paths that any of them has."""
    found: dict[int, Layout] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for gone in itertools.combinations(layout.optional, n):
                if (other := found.setdefault(fingerprint(p for p in layout.paths() if p not in gone), layout)) != layout:
                    raise ValueError(f"the layouts {other.name} and {layout.name} have the same field paths")
    return found, {p for layout in layouts for p in layout.paths()}


def _read(layouts: Sequence[Layout]) -> Column:
    known, every = _by_fingerprint(layouts)

    def of(texts: list[str]) -> pa.StructArray:
        prints, turns = [], []
        for text in texts:
            try:
                record = json.loads(text)
            except ValueError:
                record = None
            if isinstance(record, dict):
                h = fingerprint(p for p in paths_of(record) if p in every)
                layout = known.get(h)
            else:
                h, layout = None, None
            prints.append(h)
            turns.append([{"place": p, "role": r, "text": t} for p, r, t in layout.of(record)] if layout else None)
        kind = pa.list_(pa.struct([("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
        return pa.StructArray.from_arrays([pa.array(prints, pa.int64()), pa.array(turns, kind)], names=["fingerprint", "turns"])

    return of_texts(of, "fingerprint:bigint,turns:array<struct<place:bigint,role:string,text:string>>")


def layouts(df: DataFrame, *, record_col: str = "record", known: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """`fingerprint, layout, n` of the records' layouts; the layout is null where none is known, the fingerprint too where a record is no object."""
    names = {h: layout.name for h, layout in _by_fingerprint(known)[0].items()}
    listed = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    counted = named(df, record=record_col).select(_read(known)(F.col("record"))["fingerprint"].alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n"))
    return counted.select("fingerprint", listed[F.col("fingerprint")].alias("layout"), "n")


def turns(df: DataFrame, *, id_col: str = "conv_id", record_col: str = "record", known: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """`id, place, role, text` of every record's turns."""
    read = named(df, id=id_col, record=record_col).select("id", _read(known)(F.col("record"))["turns"].alias("turns"))
    return read.select("id", F.explode("turns").alias("t")).select("id", "t.place", "t.role", "t.text")


def _escaped(text: Column, escapes: Sequence[tuple[str, str]]) -> Column:
    for c, escape in escapes:
        text = F.replace(text, F.lit(c), F.lit(escape))
    return text


def formatted(df: DataFrame, *, learnt: Sequence[str] = LEARNT) -> DataFrame:
    """`id, place, said, loss_from, loss_to` of canonical turns: what each says in the template, and the code points of it that are learnt, null where none is."""
    opened = F.concat(F.lit("### "), _escaped(F.coalesce("role", F.lit("")), ESCAPES), F.lit(": "))
    text = _escaped(F.coalesce("text", F.lit("")), ESCAPES[:-1])
    rows = df.select("id", "place", F.col("role").isin(*learnt).alias("learn"), opened.alias("opened"), text.alias("text"))
    start = F.length("opened")
    return rows.select("id", "place", F.concat("opened", "text", F.lit("</turn>\n")).alias("said"), F.when(F.col("learn"), start).alias("loss_from"), F.when(F.col("learn"), start + F.length("text")).alias("loss_to"))


_TURN = re.compile(r"### ([^:<#]*+): ([^<#]*+)</turn>\n")
_ESCAPE = re.compile(r"\\(.)")
_MEANT = {escape[1]: c for c, escape in ESCAPES}


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: _MEANT[m[1]], text)


def parsed(said: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    at = 0
    while at < len(said):
        turn = _TURN.match(said, at)
        if turn is None:
            raise ValueError(f"no turn at {at}")
        yield _plain(turn[1]), _plain(turn[2])
        at = turn.end()


class _Digest:
    """What has been read of a conversation."""

    def __init__(self, id_: object) -> None:
        self.id, self.turns, self.loss, self.chars = id_, 0, 0, 0
        self.said, self.learnt = hashlib.sha256(), hashlib.sha256()

    def add(self, said: str, start: int | None, end: int | None) -> None:
        self.chars += len(said)
        for role, text in parsed(said):
            self.turns += 1
            self.said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if start is not None:
            text = _plain(said[start:end])
            self.loss += len(text)
            self.learnt.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.id, self.turns, self.said.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars


def _digests(kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    now: _Digest | None = None
    done: list[tuple] = []
    for batch in batches:
        for row in range(batch.num_rows):
            id_, said, start, end = (batch.column(c)[row].as_py() for c in ("id", "said", "loss_from", "loss_to"))
            if now is None or now.id != id_:
                if now is not None:
                    done.append(now.row())
                now = _Digest(id_)
            now.add(said, start, end)
        if done:
            yield batch_of(done)
            done = []
    if now is not None:
        yield batch_of([now.row()])


def digests(rows: DataFrame) -> DataFrame:
    """`id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars` of each conversation, read back from its formatted turns in order."""
    kind = rows.schema["id"].dataType
    empty = rows.sparkSession.createDataFrame([], f"id {kind.simpleString()}").toArrow().schema.field("id").type
    ordered = rows.repartition("id").sortWithinPartitions("id", "place", "said").select("id", "said", "loss_from", "loss_to")
    return ordered.mapInArrow(lambda b: _digests(empty, b), f"id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
