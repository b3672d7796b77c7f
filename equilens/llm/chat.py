"""Operator 10: chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document). A visitor walks the parts
in order and writes text escaped and every attachment as an ordered placeholder, noting its
reference and how many tokens the placeholder expands to. Turns are marked by control strings;
a control string (or a backslash) inside a text is escaped by a backslash, so the output can be
read back exactly. The loss mask covers the assistant turns' texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of the template, tokens per attachment
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TEXT]", "[/TEXT]",
           "<|image:", "<|audio:", "<|document:", "|>")
TOKENS = {"image": 576, "audio": 750, "document": 1024}
_CONTROL = re.compile("\\\\|" + "|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.S)
_MARK = re.compile(r"\\.|" + "|".join(re.escape(c) for c in CONTROL), re.S)
_OPEN = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
PARTS = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"
ATTACHMENTS = "array<struct<turn:bigint,position:bigint,type:string,ref:string,tokens:bigint>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Visitor:
    """Writes turns one after another; ``spans`` are the places of assistant texts."""

    def __init__(self):
        self.out: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []
        self.attachments: list[tuple] = []
        self.tokens = 0

    def write(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def visit(self, turn: int, role: str, parts) -> None:  # noqa: ANN001
        if role in _OPEN:
            opened, closed = _OPEN[role]
        else:
            opened, closed = "[ROLE]" + escape(role) + "[/ROLE][TEXT]", "[/TEXT]"
        self.write(opened)
        for position, p in enumerate(parts):
            getattr(self, "visit_" + (p["type"] or "text"), self.visit_other)(turn, position, role, p)
        self.write(closed)

    def visit_text(self, turn, position, role, p) -> None:  # noqa: ANN001
        start = self.size
        self.write(escape(p["text"] or ""))
        if role == "assistant":
            self.spans.append((start, self.size))

    def attach(self, kind, turn, position, p) -> None:  # noqa: ANN001
        n = TOKENS.get(kind, 0) if p["tokens"] is None else int(p["tokens"])
        self.attachments.append((turn, position, kind, p["ref"], n))
        self.tokens += n
        self.write(f"<|{kind}:{len(self.attachments) - 1}|>")

    def visit_image(self, turn, position, role, p) -> None:  # noqa: ANN001
        self.attach("image", turn, position, p)

    def visit_audio(self, turn, position, role, p) -> None:  # noqa: ANN001
        self.attach("audio", turn, position, p)

    def visit_document(self, turn, position, role, p) -> None:  # noqa: ANN001
        self.attach("document", turn, position, p)

    visit_other = visit_text


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation; placeholders stay in the text."""
    out: list[tuple[str, str]] = []
    at = 0
    by_open = {o: (r, c) for r, (o, c) in _OPEN.items()}

    def until(at: int, close: str) -> tuple[str, int]:
        """Escaped text up to an unescaped ``close`` and the place behind it."""
        for m in _MARK.finditer(formatted, at):
            if m[0] == close:
                return formatted[at:m.start()], m.end()
        raise ValueError("unclosed turn")

    while at < len(formatted):
        for o, (role, close) in by_open.items():
            if formatted.startswith(o, at):
                text, at = until(at + len(o), close)
                break
        else:
            if not formatted.startswith("[ROLE]", at):
                raise ValueError(f"no turn at {at}")
            name, at = until(at + 6, "[/ROLE]")
            role = unescape(name)
            text, at = until(at + 6, "[/TEXT]")
        out.append((role, unescape(text)))
    return out


def text_parts(text) -> F.Column:
    """A content list of one text part (null text: empty)."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))).cast(PARTS)


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts_col: str = "parts") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, attachments, attachment_tokens) per conversation.

    ``parts_col`` holds arrays of struct(type, text, ref, tokens); null parts or texts are empty,
    a null or unknown type is text, null tokens take the type's default. Turns are ordered by
    turn (null first); rows that share a turn, repeated rows too, all stay, ordered by role and
    content. A null role is the empty role. Rows with a null conversation id form one
    conversation with a null id. A conversation is one output value, so its rows meet in one
    task; conversations are spread by id. Other columns are ignored; no rows give no rows.
    """
    row = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                   F.coalesce(F.col(parts_col).cast(PARTS), F.array().cast(PARTS)).alias("parts"))
    convs = turns.select(F.col(conv_col).cast("long").alias("conv_id"), row.alias("r")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("r")).alias("turns"))

    @F.pandas_udf("formatted string, loss_spans array<struct<start:bigint,end:bigint>>, "
                  f"attachments {ATTACHMENTS}, attachment_tokens bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for convs in batches:
            rows = []
            for turns in convs:
                v = Visitor()
                for t in turns:
                    v.visit(t["turn"], t["role"], t["parts"])
                rows.append(("".join(v.out), [{"start": a, "end": b} for a, b in v.spans],
                             [dict(zip(("turn", "position", "type", "ref", "tokens"), a)) for a in v.attachments], v.tokens))
            yield pd.DataFrame(rows, columns=["formatted", "loss_spans", "attachments", "attachment_tokens"])

    out = convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), run.asNondeterministic()("turns").alias("f"))
    return out.select("conv_id", "n_turns", "f.*")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from
    the output: turns by parsing it, the loss text by its spans."""

    @F.pandas_udf("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = []
            for text, where in zip(texts, spans):
                turns = read_back(text)
                h = hashlib.sha256()
                for role, t in turns:
                    h.update(f"{role}\n{t}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in where)
                rows.append((len(turns), h.hexdigest(), len(loss),
                             hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", run.asNondeterministic()("formatted", "loss_spans").alias("d")).select("conv_id", "d.*")
