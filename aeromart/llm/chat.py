"""Chat formatting by prefix targets: every assistant turn is an example of
its own, with all turns before it as context and only its text trainable.

A turn is a piece of the template:

    <|im_start|>role NEWLINE text <|im_end|> NEWLINE

``formatted_examples`` writes a row for each example, that is, for each
assistant turn: its text is all pieces of its conversation up to that turn,
and the characters from ``loss_start`` to ``loss_end`` are trainable.  Turns
after the last assistant turn are in an example without a trainable
character, so every turn is in one.  ``read_example_digests`` gets turns and
targets back from the texts.

``formatted_turns`` returns the pieces alone, each once, with their place in
the conversation's formatted text; ``examples`` has the sizes and targets
that follow from them, ``example_texts`` the texts, and
``read_conversations`` and ``read_digests`` read turns and targets back.

Escapes: in role and text a backslash is doubled and ``<|`` becomes
``<\\|``, so no text can hold a control string; a line end in a role becomes
``\\n``.  ``unescaped`` reverses this.

Rows go by ``turn`` (null first); rows of one turn by role, then text.
Repeated rows are turns of their own.  A null role or text is an empty one.
Rows without conv_id are one conversation, with a null id.  Other columns
are not read.  An empty table has no pieces and no examples.

A conversation is read in order by one task, batch by batch.  The pieces
are placed and read without holding its turns together; the examples, which
are prefixes of one another, need its text so far, and their size grows with
the square of its turns, as the method has it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeromart.llm.common import shuffle_partitions

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
ESCAPE = re.compile(r"\\(.)", re.DOTALL)
#: a piece of the template; role and text are escaped
PIECE = re.compile(re.escape(START) + r"(.*?)\n(.*)" + re.escape(END), re.DOTALL)
#: pieces end to end; no escaped text holds a control string
PIECES = re.compile(re.escape(START) + r".*?" + re.escape(END), re.DOTALL)
TURNS = "conv_id long, seq long, example long, trained boolean, piece string, char_start long, loss_start long, loss_end long"
EXAMPLES = "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long"
#: characters of the texts that are handed on together (a longer one is alone)
BATCH_CHARS = 1 << 22
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, n_examples long, loss_chars long, loss_sha256 string, formatted_chars long, stored_chars long"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: str) -> str:
    return ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their place; conversations come in order, one after another."""
    conv, seq, example, at = (), 0, 0, 0
    for batch in batches:
        ids, trained = batch.column("conv_id").to_pylist(), batch.column("trained").to_pylist()
        lengths, heads = batch.column("n").to_pylist(), batch.column("head").to_pylist()
        rows = []
        for own, yes, n, head in zip(ids, trained, lengths, heads, strict=True):
            if (own,) != conv:
                conv, seq, example, at = (own,), 0, 0, 0
            loss = (at + head, at + n - len(END)) if yes else (None, None)
            rows.append((seq, example, at, *loss))
            seq, example, at = seq + 1, example + yes, at + n
        seqs, examples_, starts, *losses = (pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5))
        columns = [batch.column("conv_id"), seqs, examples_, batch.column("trained"), batch.column("piece"), starts, *losses]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "seq", "example", "trained", "piece", "char_start", "loss_start", "loss_end"])


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """A row for each row of ``conversations`` (conv_id, turn, role, text):
    its place ``seq``, its ``piece`` of the formatted text, which starts at
    ``char_start``, the example it is first part of, and for assistant turns
    (``trained``) the trainable characters' place."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    header = F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    pieces = (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
        .repartition(shuffle_partitions(conversations.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", (F.col("role") == TRAINED_ROLE).alias("trained"), header.alias("header"), F.concat(header, escaped(F.col("text")), F.lit(END)).alias("piece"))
        .select("conv_id", "trained", "piece", F.length("piece").cast("long").alias("n"), F.length("header").cast("long").alias("head"))
    )
    return pieces.mapInArrow(_placed, TURNS)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The examples of pieces that come in order, with their texts."""
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in EXAMPLES.split(", "))])
    rows, size = [], 0

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def add(*row) -> None:
        nonlocal size
        rows.append(row)
        size += len(row[3])

    conv, example, n, text, unended = None, 0, 0, "", False
    for batch in batches:
        for own, seq, k, piece, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "example", "piece", "loss_start", "loss_end")), strict=True):
            if seq == 0:
                if unended:
                    add(conv, example, n, text, None, None)
                conv, text = own, ""
            example, n, text, unended = k, seq + 1, text + piece, lo is None
            if not unended:
                add(conv, example, n, text, lo, hi)
            if size > BATCH_CHARS:
                yield flushed()
                rows, size = [], 0
    if unended:
        add(conv, example, n, text, None, None)
    yield flushed()


def formatted_examples(conversations: DataFrame) -> DataFrame:
    """A row for each example of ``conversations`` (conv_id, turn, role, text):
    its number in the conversation, the turns its ``text`` has, the text
    itself, and the place of its trainable characters in it (null in the
    example of turns that no assistant turn follows)."""
    return formatted_turns(conversations).mapInArrow(_prefixes, EXAMPLES)


def examples(turns: DataFrame) -> DataFrame:
    """The examples of ``formatted_turns``: conv_id, example, the number of
    turns and of characters that its text has, and its trainable characters
    (null in the example of turns that no assistant turn follows)."""
    ends = F.col("char_start") + F.length("piece")
    return turns.groupBy("conv_id", "example").agg(
        (F.max("seq") + 1).alias("n_turns"), F.max(ends).alias("n_chars"), F.max("loss_start").alias("loss_start"), F.max("loss_end").alias("loss_end")
    )


def example_texts(turns: DataFrame) -> DataFrame:
    """``examples`` with their ``text`` written out.  Its size is that of all
    prefixes, so it is for the reader of a part of the examples."""
    spans = turns.groupBy("conv_id", "example").agg(F.sort_array(F.collect_list(F.struct("seq", "piece"))).alias("own"), F.max("loss_start").alias("loss_start"), F.max("loss_end").alias("loss_end"))
    spans = spans.withColumn("own", F.array_join(F.transform("own", lambda x: x["piece"]), ""))
    before = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, 0)
    return spans.select("conv_id", "example", F.array_join(F.collect_list("own").over(before), "").alias("text"), "loss_start", "loss_end")


class _Digest:
    """What is read back of one conversation."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.n_examples = self.loss_chars = self.stored = self.formatted = 0
        self.open = False

    def add(self, piece: str, start: int, lo: int | None, hi: int | None) -> None:
        role, text = PIECE.fullmatch(piece).groups()
        self.turns.update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
        self.n_turns += 1
        self.stored = start + len(piece)
        self.open = lo is None
        if lo is not None:
            trained = unescaped(piece[lo - start : hi - start])
            self.loss.update(trained.encode())
            self.loss_chars += len(trained)
            self.n_examples += 1
            self.formatted += self.stored  # the example is all text so far

    def row(self) -> tuple:
        n, chars = self.n_examples + self.open, self.formatted + self.stored * self.open
        return self.conv_id, self.n_turns, self.turns.hexdigest(), n, self.loss_chars, self.loss.hexdigest(), chars, self.stored


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(found: list[tuple]) -> pa.RecordBatch:
        schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n, _ in (x.split() for x in DIGESTS.split(", "))])
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)

    digest = None
    for batch in batches:
        found = []
        for conv, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "char_start", "loss_start", "loss_end")), strict=True):
            if digest is None or conv != digest.conv_id:
                found += [digest.row()] if digest else []
                digest = _Digest(conv)
            digest.add(*turn)
        yield rows(found)
    if digest:
        yield rows([digest.row()])


def _digested_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n, _ in (x.split() for x in DIGESTS.split(", "))])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)

    def row() -> tuple:
        turns, n = hashlib.sha256(), 0
        for role, own in (PIECE.fullmatch(p).groups() for p in PIECES.findall(text)):  # the last example has all turns
            turns.update(f"{unescaped(role)}\n{unescaped(own)}\n".encode())
            n += 1
        return conv, n, turns.hexdigest(), n_examples, loss_chars, loss.hexdigest(), formatted, len(text)

    conv, text, loss, loss_chars, n_examples, formatted = None, None, hashlib.sha256(), 0, 0, 0
    for batch in batches:
        found = []
        for own, now, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end")), strict=True):
            if text is None or own != conv:
                found += [] if text is None else [row()]
                conv, loss, loss_chars, n_examples, formatted = own, hashlib.sha256(), 0, 0, 0
            text, n_examples, formatted = now, n_examples + 1, formatted + len(now)
            if lo is not None:
                trained = unescaped(now[lo:hi])
                loss.update(trained.encode())
                loss_chars += len(trained)
        yield rows(found)
    if text is not None:
        yield rows([row()])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [PIECE.fullmatch(p).groups() for p in batch.column("piece").to_pylist()]
        role, text = ([unescaped(x[i]) for x in found] for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("seq"), pa.array(role, pa.string()), pa.array(text, pa.string()), batch.column("trained")],
            ["conv_id", "seq", "role", "text", "trained"],
        )


def read_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, seq, role, text and trained of every turn, unescaped."""
    return turns.mapInArrow(_read, "conv_id long, seq long, role string, text string, trained boolean")


def read_digests(turns: DataFrame) -> DataFrame:
    """A row for each conversation, read from its pieces in order: digests of
    its turns and of its trainable text, the number of its examples, the
    characters of all their texts (``formatted_chars``) and of the pieces."""
    ordered = turns.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(_digested, DIGESTS)


def read_example_digests(examples: DataFrame) -> DataFrame:
    """As ``read_digests``, read from the texts of ``formatted_examples``: the
    targets from each, the turns from a conversation's last, and
    ``formatted_chars`` as the characters of all; ``stored_chars`` are those
    of the last."""
    ordered = examples.repartition(shuffle_partitions(examples.sparkSession), "conv_id").sortWithinPartitions("conv_id", "example")
    return ordered.mapInArrow(_digested_examples, DIGESTS)
