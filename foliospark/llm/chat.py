"""Chat formatting with typed content parts.

A message is a role and an ordered list of content parts of type text, image, audio or document. A
visitor turns each part into text or a placeholder, records the attachment and counts the tokens the
placeholder will expand to. The template marks turns:

    <|im_start|>ROLE\\n CONTENT <|im_end|>\\n

Inside roles and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``, in roles also a line end ``\\n``, so no
text can hold a control string, no role ends early and the original comes back exactly.

A formatted conversation is the concatenation of its turn segments in order (turn, then role, then
text). Segments stay rows, so a conversation of any length is never one value in memory.

Defined results: null role, text or reference counts as empty; null parts as no parts; a part of unknown
type raises; equal rows stay separate turns; a null turn comes first; a null conv_id is one conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
SEGMENT = (
    "conv_id long, turn long, role string, segment string, loss_start int, loss_end int, n_tokens long, "
    "attachments array<struct<kind:string,ref:string,at:int,tokens:int>>"
)
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str | None) -> str:
    return (text or "").replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def escape_role(role: str | None) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], role)


class PartVisitor:
    """Flattens the parts of one message: text, attachments and expanded tokens.

    An image takes one token for each patch square, audio ``audio_rate`` tokens a second and a document
    ``page_tokens`` a page, one token at least; text counts its white-space words.
    """

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 256):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.out: list[str] = []
        self.length = self.tokens = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("type")
        if kind not in ("text", "image", "audio", "document"):
            raise ValueError(f"unknown content part: {kind!r}")
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self._add(escape(text), len(text.split()))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(k) or 0) / self.patch) for k in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.page_tokens)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        tokens = max(1, tokens)
        self.attachments.append({"kind": kind, "ref": part.get("ref") or "", "at": self.length, "tokens": tokens})
        self._add(f"<|{kind}:{len(self.attachments) - 1}|>", tokens)

    def _add(self, text: str, tokens: int) -> None:
        self.out.append(text)
        self.length += len(text)
        self.tokens += tokens


def format_segments(messages: DataFrame, trained_role: str = "assistant", **sizes) -> DataFrame:
    """One segment for each row of ``messages`` (conv_id, turn, role, parts), with the loss mask of the trained role.

    loss_start and loss_end are code-point offsets in the segment (equal where nothing is trained on); an
    attachment's ``at`` counts from the start of the content.
    """

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, turn, role, parts in zip(batch["conv_id"], batch["turn"], batch["role"], batch["parts"], strict=True):
                visitor = PartVisitor(**sizes)
                for part in [] if parts is None else parts:
                    visitor.visit(part)
                role = role or ""
                head, content = f"{START}{escape_role(role)}\n", "".join(visitor.out)
                trained = len(head) if role == trained_role else 0
                rows.append(
                    (
                        None if pd.isna(conv) else int(conv),
                        None if pd.isna(turn) else int(turn),
                        role,
                        f"{head}{content}{END}\n",
                        trained,
                        trained and trained + len(content),
                        visitor.tokens,
                        visitor.attachments,
                    )
                )
            names = [x.split()[0] for x in SEGMENT.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64", "turn": "Int64"})

    return messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "parts").mapInPandas(formatted, SEGMENT)


def text_messages(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages of one text part."""
    return turns.select(
        "conv_id",
        "turn",
        "role",
        F.array(F.expr("named_struct('type','text','text',coalesce(text,''),'ref',null,'width',null,'height',null,'seconds',null,'pages',null)").cast(PART)).alias("parts"),
    )


def read_back(segments: DataFrame) -> DataFrame:
    """Reads formatted conversations: turns, a digest of them, and what the loss mask covers.

    Rows are shuffled by conversation and sorted; a task then streams through them and holds the running
    digests of one conversation, whatever its length. Segments of an unfinished conversation carry over
    from batch to batch.
    """

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_attachments"]
        now, state = None, None

        def row():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5], state[6])

        for batch in batches:
            done = []
            for conv, segment, start, end, tokens, attached in zip(
                batch["conv_id"], batch["segment"], batch["loss_start"], batch["loss_end"], batch["n_tokens"], batch["n_attachments"], strict=True
            ):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or conv != now:
                    if state is not None:
                        done.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for found in _TURN.finditer(segment):
                    state[0] += 1
                    state[1].update(f"{unescape_role(found[1])}\n{unescape(found[2])}\n".encode("utf-8", "surrogatepass"))
                loss = unescape(segment[start:end])
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
                state[5] += tokens
                state[6] += attached
            if done:
                yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
        if state is not None:
            yield pd.DataFrame([row()], columns=names).astype({"conv_id": "Int64"})

    ordered = (
        segments.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end", "n_tokens", F.size("attachments").alias("n_attachments"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "segment")
    )
    return ordered.select("conv_id", "segment", "loss_start", "loss_end", "n_tokens", "n_attachments").mapInPandas(
        digested,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_attachments long",
    )
