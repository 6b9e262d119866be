"""Chat formatting of typed content parts, with a loss mask, and the way back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# A turn reads: <turn>### Role: text</turn> and a line break.
OPEN, HEAD, COLON, CLOSE = "<turn>", "### ", ": ", "</turn>\n"
OTHER = "role="
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
KINDS = ("text", "image", "audio", "document")
PART = "type string, text string, ref string, width int, height int, seconds double, pages int"

# Characters that begin a string that steers the format, and the backslash itself.
_STEERING = re.compile(r"\\|<(?=/?turn>|\|)|#(?=##)")
_PARTED = re.compile(r"\\(.)", re.DOTALL)
_ROLE = re.compile(r"((?:[^:\\]|\\.)*): ", re.DOTALL)


def escape(text: str) -> str:
    r"""The text with a backslash behind every character that begins a control string.

    ``</turn>`` becomes ``<\/turn>``, a backslash two: no control string is left.
    """
    return _STEERING.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _PARTED.sub(r"\1", text)


@dataclass(frozen=True)
class Costs:
    """How many tokens a placeholder stands for."""

    patch: int = 14
    image_least: int = 16
    audio_per_second: float = 25.0
    document_per_page: int = 256


@dataclass
class Flattened:
    """Parts in order as one text, with what each placeholder refers to."""

    text: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int]] = field(default_factory=list)


class PartVisitor:
    """Visits parts in order; one method per type. Unknown types are an error."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.result = Flattened()

    def visit(self, part: Mapping | Row) -> None:
        part = part.asDict() if isinstance(part, Row) else part
        kind = part.get("type") or "text"
        if kind not in KINDS:
            raise ValueError(f"unknown content part: {kind!r}")
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: Mapping) -> None:
        self.result.text.append(escape(part.get("text") or ""))

    def visit_image(self, part: Mapping) -> None:
        width, height = part.get("width") or 0, part.get("height") or 0
        patches = -(-int(width) // self.costs.patch) * -(-int(height) // self.costs.patch)
        self._attach("image", part, max(patches, self.costs.image_least))

    def visit_audio(self, part: Mapping) -> None:
        seconds = part.get("seconds") or 0.0
        self._attach("audio", part, max(1, round(seconds * self.costs.audio_per_second)))

    def visit_document(self, part: Mapping) -> None:
        self._attach("document", part, max(1, int(part.get("pages") or 1)) * self.costs.document_per_page)

    def _attach(self, kind: str, part: Mapping, tokens: int) -> None:
        number = len(self.result.attachments)
        self.result.text.append(f"<|{kind}:{number}|>")
        self.result.attachments.append((number, kind, part.get("ref"), tokens))


def flatten(parts: Iterable[Mapping] | None, costs: Costs = Costs()) -> Flattened:
    visitor = PartVisitor(costs)
    for part in [] if parts is None else parts:
        if part is not None:
            visitor.visit(part)
    return visitor.result


def turn_text(role: str | None, body: str) -> str:
    """One formatted turn. Roles without a name of their own are spelled out, escaped."""
    shown = ROLES.get(role or "") or OTHER + escape(role or "").replace(":", "\\:")
    return f"{OPEN}{HEAD}{shown}{COLON}{body}{CLOSE}"


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, unescaped body, start and end of the body) of every turn of a formatted text.

    Bodies hold no control string, so the next closing mark is the turn's own.
    """
    names = {shown: role for role, shown in ROLES.items()}
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN + HEAD, at):
            raise ValueError(f"no turn at {at}")
        head = _ROLE.match(formatted, at + len(OPEN + HEAD))
        end = formatted.find(CLOSE, at)
        if head is None or end < head.end():
            raise ValueError(f"broken turn at {at}")
        role = names.get(head[1]) or unescape(head[1].removeprefix(OTHER))
        yield role, unescape(formatted[head.end() : end]), head.end(), end
        at = end + len(CLOSE)


SEGMENT = (
    "conv_id bigint, turn bigint, segment string, loss_start int, loss_end int, tokens_expanded bigint, "
    "attachments array<struct<number: int, kind: string, ref: string, tokens: int>>"
)


def as_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    nothing = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), text.alias("text"), nothing.cast("string").alias("ref"),
            nothing.cast("int").alias("width"), nothing.cast("int").alias("height"),
            nothing.cast("double").alias("seconds"), nothing.cast("int").alias("pages"),
        )
    )


def format_turns(turns: DataFrame, costs: Costs = Costs(), train_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """Each turn (conv_id, turn, role, parts) as its segment of the formatted conversation.

    A conversation's text is its segments in order of turn, so no conversation is gathered to
    be formatted. ``loss_start`` and ``loss_end`` bound the characters of the segment to train
    on (null for other roles), ``attachments`` are the placeholders in order and
    ``tokens_expanded`` is the sum of what they stand for. Null roles, texts, parts and lists
    count as empty.
    """

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "turn", "segment", "loss_start", "loss_end", "tokens_expanded", "attachments"]
        for batch in batches:
            rows = []
            for conv, turn, role, parts in batch.itertuples(index=False, name=None):
                flat = flatten(parts, costs)
                body = "".join(flat.text)
                segment = turn_text(role, body)
                end = len(segment) - len(CLOSE)
                bounds = (end - len(body), end) if role in train_roles else (None, None)
                attached = [dict(zip(("number", "kind", "ref", "tokens"), a)) for a in flat.attachments]
                rows.append((conv, turn, segment, *bounds, sum(a[3] for a in flat.attachments), attached))
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "parts")
    return rows.mapInPandas(formatted, SEGMENT)


DIGEST = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, tokens_expanded bigint"
)


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars, self.expanded = conv, 0, 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start, end, expanded) -> None:
        for role, body, _, _ in read_turns(segment):
            self.turns += 1
            self.said.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
        if not pd.isna(start):
            trained = unescape(segment[int(start) : int(end)])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode("utf-8", "surrogatepass"))
        self.chars += len(segment)
        self.expanded += int(expanded)

    def row(self) -> tuple:
        digests = self.said.hexdigest(), self.loss_chars, self.loss.hexdigest()
        return None if pd.isna(self.conv) else int(self.conv), self.turns, *digests, self.chars, self.expanded


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in DIGEST.split(", ")]
    now: _Digest | None = None
    for batch in batches:
        done = []
        for conv, segment, start, end, expanded in batch.itertuples(index=False, name=None):
            if now is None or not (conv == now.conv or (pd.isna(conv) and pd.isna(now.conv))):
                done += [now.row()] if now else []
                now = _Digest(conv)
            now.add(segment, start, end, expanded)
        yield pd.DataFrame(done, columns=names, dtype=object)
    if now is not None:
        yield pd.DataFrame([now.row()], columns=names, dtype=object)


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text says when it is read back.

    Segments are sorted by conversation and turn and read as a stream: a digest over all turns
    of a conversation needs them in one order, but none is held in memory. Rows that tie on the
    turn are ordered by their segment; rows without a conversation are one conversation.
    """
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    columns = ["conv_id", "segment", "loss_start", "loss_end", "tokens_expanded"]
    return ordered.select(*columns).mapInPandas(_digests, DIGEST)


def formatted_conversations(segments: DataFrame) -> DataFrame:
    """(conv_id, text): whole formatted conversations, one row each."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "segment")))
    return segments.groupBy("conv_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["segment"]), "").alias("text")
    )
