"""Chat formatting: records of any known layout to canonical turns, to one template, and back.

A record is a JSON text. The sorted set of its nested field paths is hashed; that fingerprint
selects a declarative mapping, which says where roles and texts are. Mappings are data: a new
layout is one more entry. Canonical turns become template pieces, one per turn, with the span
that a loss covers; the pieces of a conversation in order are its formatted text, so that a
conversation of any length is never one row.

Texts may hold anything: every backslash is doubled and a backslash is put inside every
control string, so a reader that drops each escaping backslash gets the text back.

A text may be a list of strings or of `{"type", "text"}` parts, which are put together as they are.
Fields of METADATA beside turns or in them, with all below, play no part in the fingerprint.

Defined cases: a null or missing text is empty; a record that is no JSON object or whose
layout is unknown yields one row with a null `layout` and no text; equal turn numbers are
ordered by role, then text; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.llm.arrays import map_slices, tuned
from quaestor.operators.ordering import running_before

TURN, END = "<|im_start|>", "<|im_end|>\n"
# what a text must not hold unescaped: this template's marks and those of other public templates
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
METADATA = frozenset("id name source model lang language category tags metadata meta created timestamp weight".split())
RECORD_TURNS = 8  # of the records that `as_records` makes


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns: fixed fields by role, or a list of message objects."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()  # (role, field), in order
    listed: str | None = None  # the list's field
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)  # other names of roles
    optional: tuple[str, ...] = ()  # fields that may be missing
    joined: tuple[str, ...] = ()  # fields that one turn shares, parted by an empty line

    def paths(self) -> list[set[str]]:
        """The path sets of this layout, with and without its optional fields."""
        if self.listed:
            inner = {f"{self.listed}[].{self.role}", f"{self.listed}[].{self.text}"}
            parts = {f"{self.listed}[].{self.text}[].type", f"{self.listed}[].{self.text}[].text"}
            must, may = [inner, inner | parts, set()], self.optional
            return [({self.listed} | i) | set(o) for i in must for n in range(len(may) + 1) for o in itertools.combinations(may, n)]
        must = {f for _, f in self.fields} - set(self.optional)
        return [must | set(o) for n in range(len(self.optional) + 1) for o in itertools.combinations(self.optional, n)]


MAPPINGS = (
    Mapping("messages", listed="messages"),
    Mapping("conversations", listed="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Mapping("prompt_completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system", "completion")),
    Mapping("completion", (("assistant", "completion"),)),
    Mapping("instruction", (("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input", "output"), joined=("instruction", "input")),
    Mapping("output", (("assistant", "output"),)),
    Mapping("question_answer", (("user", "question"), ("assistant", "answer")), optional=("answer",)),
)


def field_paths(value, prefix: str = "") -> set[str]:
    """All nested field paths but those of METADATA; items of a list share the path `[]`."""
    found: set[str] = set()
    if isinstance(value, dict):
        for key, inner in value.items():
            if key in METADATA:
                continue
            path = f"{prefix}.{key}" if prefix else key
            found |= {path} | field_paths(inner, path)
    elif isinstance(value, list):
        for inner in value:
            found |= field_paths(inner, f"{prefix}[]")
    return found


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()


BY_FINGERPRINT = {fingerprint(p): m for m in MAPPINGS for p in m.paths()}


def _string(value) -> str:
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    # half of a surrogate pair, which JSON can escape, is no character
    return text.encode("utf-8", "replace").decode()


def _text(value) -> str:
    """A text given as such or in parts."""
    if isinstance(value, list) and all(isinstance(v, str) or isinstance(v, dict) and "text" in v for v in value):
        return "".join(_string(v if isinstance(v, str) else v["text"]) for v in value)
    return _string(value)


def turns_of(record: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout name and canonical (role, text) turns of one record. What is no JSON, is nested too
    deeply to be read, or has something else where a layout has its list of objects, has no layout."""
    try:
        return _turns(json.loads(record or ""))
    except (ValueError, RecursionError):
        return None, []


def _turns(value) -> tuple[str | None, list[tuple[str, str]]]:
    mapping = BY_FINGERPRINT.get(fingerprint(field_paths(value))) if isinstance(value, dict) else None
    if mapping is None:
        return None, []
    if mapping.listed:
        items = [] if value[mapping.listed] is None else value[mapping.listed]
        if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
            return None, []
        names = [_string(i.get(mapping.role)) for i in items]
        return mapping.name, [(mapping.roles.get(n, n), _text(i.get(mapping.text))) for n, i in zip(names, items)]
    out: list[tuple[str, str]] = []
    for role, name in mapping.fields:
        if name not in value:
            continue
        text = _text(value[name])
        if name in mapping.joined and out and out[-1][0] == role:
            if text:
                out[-1] = (role, f"{out[-1][1]}\n\n{text}")
        else:
            out.append((role, text))
    return mapping.name, out


def canonical_turns(records: DataFrame, carry: tuple[str, ...], record: str = "record") -> DataFrame:
    """`carry` columns, `layout`, `part` (turn inside the record), `role`, `text`."""
    fields = records.select(*carry).schema.fields

    def run(batch: pa.RecordBatch) -> dict:
        at, layouts, parts, roles, texts = [], [], [], [], []
        for i, value in enumerate(batch.column(record).to_pylist()):
            layout, turns = turns_of(value)
            for k, (role, text) in enumerate(turns or ([] if layout else [(None, None)])):
                at.append(i), layouts.append(layout), parts.append(k), roles.append(role), texts.append(text)
        rows = pa.array(at, pa.int64())
        return {c: batch.column(c).take(rows) for c in carry} | {
            "layout": pa.array(layouts, pa.string()),
            "part": pa.array(parts, pa.int32()),
            "role": pa.array(roles, pa.string()),
            "text": pa.array(texts, pa.string()),
        }

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_slices(records.select(*carry, record), run, f"{schema}, layout string, part int, role string, text string", record)


def escape(text: Column) -> Column:
    """Reversible: no control string is left."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """Add `piece`, the turn in the template, and the loss span in it: `loss_from` (1-based)
    and `loss_len` in code points, 0 where the turn carries no loss."""
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\\n"))
    head = F.concat(F.lit(TURN), role, F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    loss = F.col("role").eqNullSafe(LOSS_ROLE)
    return turns.withColumns(
        {
            "piece": F.concat(head, body, F.lit(END)),
            "loss_from": F.when(loss, F.length(head) + 1).otherwise(0),
            "loss_len": F.when(loss, F.length(body)).otherwise(0),
        }
    )


def read_back(pieces: DataFrame) -> DataFrame:
    """`role` and `text` parsed from `piece`, and `loss`, the unescaped text under the mask."""
    role = r"((?:[^\\\n]|\\[\s\S])*)"
    pattern = rf"\A\Q{TURN}\E{role}\n([\s\S]*)\Q{END[:-1]}\E\n\z"
    return pieces.withColumns(
        {
            "role": unescape(F.regexp_extract("piece", pattern, 1)),
            "text": unescape(F.regexp_extract("piece", pattern, 2)),
            "loss": unescape(F.expr("substring(piece, loss_from, loss_len)")),
        }
    )


def digest(turns: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Per conversation the counts and digests of its turns (`role`, `text`, `loss`, `piece`).

    A digest needs its turns in order, so a conversation is read by one task, as a sorted
    stream: memory holds one batch, whatever the conversation's length.
    """
    kind = turns.schema[key].dataType.simpleString()
    columns = [key, *order, "role", "text", "loss", "piece"]
    placed = turns.select(*dict.fromkeys(columns)).repartition(key).sortWithinPartitions(key, *order)

    def run(batches):
        open_key, state = None, None

        def row(k, s):
            return pa.record_batch(
                [pa.array([k], key_type), pa.array([s[0]], pa.int64()), pa.array([s[1].hexdigest()]), pa.array([s[2]], pa.int64()),
                 pa.array([s[3].hexdigest()]), pa.array([s[4]], pa.int64())],
                names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        done = []
        for batch in batches:
            key_type = batch.schema.field(key).type
            for k, role, text, loss, piece in zip(*(batch.column(c).to_pylist() for c in (key, "role", "text", "loss", "piece"))):
                if state is None or k != open_key:
                    if state is not None:
                        done.append(row(open_key, state))
                    open_key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(piece)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if state is not None:
            yield row(open_key, state)

    return tuned(placed).mapInArrow(
        run, f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def as_records(conversations: DataFrame) -> DataFrame:
    """Conversations as JSON records in four public layouts: `conv_id`, `chunk` (the record's place
    in its conversation), `record`.

    Two layouts list up to RECORD_TURNS turns in a row, two hold a user's turn and the answer to
    it; runs of turns that a layout has no place for are in the `messages` layout. Turns are dealt
    by their position in the conversation, which comes from a range sort, so that a conversation
    of any length is cut into records of bounded length.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = running_before(rows, ["conv_id"], ["turn", "role", "text"], out="place")
    way = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4))
    chunk = F.floor(F.col("place") / F.when(way < 2, RECORD_TURNS).otherwise(2))
    # at most RECORD_TURNS rows to a group
    dealt = placed.withColumn("chunk", chunk).groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("t")
    )
    roles, first, second = F.col("t.role"), F.col("t")[0]["text"], F.get("t", 1)["text"]
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    named = F.transform("t", lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["text"].alias("value")))
    whole = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    record = (
        F.when((way == 1) & F.forall("t", lambda t: t["role"].isin("user", "assistant")), F.to_json(F.struct(named.alias("conversations"))))
        .when((way == 2) & pair, F.to_json(F.struct(first.alias("prompt"), second.alias("completion"))))
        .when((way == 3) & pair, F.to_json(F.struct(first.alias("instruction"), second.alias("output"))))
        .otherwise(F.to_json(F.struct(whole.alias("messages"))))
    )
    return dealt.select("conv_id", "chunk", record.alias("record"))
