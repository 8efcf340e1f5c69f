"""Chat formatting: roles recovered from transcripts by a hidden Markov model, then canonical turns.

Hidden states are (role, begins or continues a turn); a line of the transcript is one observation, made of a speaker-marker
class and line features that are independent given the state. Start, transition and emission tables are counted from
transcripts with known roles, over the whole table, with add-one smoothing; Viterbi finds the best path in log space.
A path begins with a beginning state and a turn continues with its own role only. Markers that the path confirms (a role
marker at a line that begins a turn) are cut off; any other text stays as it is.

Canonical turn: ``<|role|>``, line break, the text without outer blank lines, line break, ``<|end|>``, line break. No text can
forge a marker: ``<|`` in it becomes ``<\\|``, and where there are backslashes between the two already, one more; ``unrender`` takes
the turns back out.

Defined cases: null transcript and one without a visible character have no turns; blank lines belong to the turn before
them; a marker alone on its line begins a turn whose text follows; ties between paths go to the state named first; without
any known transcript all tables are uniform, so the markers decide nothing and ties make all one user turn; very long
transcripts and names of any length are read whole; a text that spells markers stays text; an empty table gives no row; repeated
rows and null ids are parsed as they come; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

ROLES = ("user", "assistant", "system")
STATES = [(r, k) for r in ROLES for k in ("begin", "inside")]
_INDEX = {s: i for i, s in enumerate(STATES)}
_WORDS = {"user": "user", "human": "user", "q": "user", "question": "user", "customer": "user", "instruction": "user", "prompter": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "answer": "assistant", "response": "assistant", "agent": "assistant", "system": "system", "context": "system"}
_MARK = re.compile(r"^\s*(?:<\|?\s*(?P<tag>[A-Za-z]+)\s*\|?>|\[(?P<box>[A-Za-z]+)\]|#{2,}\s*(?P<hash>[A-Za-z]+)\s*:?|\**(?P<word>[A-Za-z]+)\**\s*[:>]\**)[ \t]*")
_OTHER = re.compile(r"^\s*\S+:\s")
# (name, number of symbols) of the features of a line
# the marker together with whether a blank line comes before: a turn without a marker begins behind one
FEATURES = (("marker", 10), ("first", 2), ("question", 2), ("length", 4), ("lead", 4))


def marker(line: str) -> tuple[int, int]:
    """(class, width): 0 none, 1-3 a role's marker, 4 some other name with a colon."""
    m = _MARK.match(line)
    if m:
        role = _WORDS.get(next(x for x in m.groups() if x).lower())
        if role:
            return 1 + ROLES.index(role), m.end()
    return (4, 0) if _OTHER.match(line) else (0, 0)


def observe(lines: list[str]) -> np.ndarray:
    """One row of feature symbols per line."""
    out = np.zeros((len(lines), len(FEATURES)), dtype=np.int64)
    for i, line in enumerate(lines):
        text = line.strip()
        n = len(text)
        lead = 0 if not text else 1 if text[0].isupper() else 2 if text[0] in "-*#>|`0123456789" else 3
        out[i] = (2 * marker(line)[0] + int(i > 0 and not lines[i - 1].strip()), int(i == 0), int(text.endswith("?")), 0 if n == 0 else 1 if n < 60 else 2 if n < 240 else 3, lead)
    return out


class RoleModel:
    """Log tables: start[state], move[state, state] and emit[feature][state, symbol]."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]):
        begins = np.array([k == "begin" for _, k in STATES])
        role = np.array([ROLES.index(r) for r, _ in STATES])
        allowed = begins[None, :] | (role[:, None] == role[None, :])
        with np.errstate(divide="ignore"):
            self.start = np.log(np.where(begins, start + 1, 0) / np.where(begins, start + 1, 0).sum())
            m = np.where(allowed, move + 1, 0)
            self.move = np.log(m / m.sum(axis=1, keepdims=True))
        self.emit = [np.log((e + 1) / (e + 1).sum(axis=1, keepdims=True)) for e in emit]

    def viterbi(self, obs: np.ndarray) -> list[int]:
        e = sum(t[:, obs[:, f]] for f, t in enumerate(self.emit))
        score, back = self.start + e[:, 0], []
        for i in range(1, len(obs)):
            s = score[:, None] + self.move
            back.append(s.argmax(axis=0))
            score = s.max(axis=0) + e[:, i]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def parse(transcript: str | None, model: RoleModel) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    if not transcript or not transcript.strip():
        return []
    lines = transcript.split("\n")
    while not lines[0].strip():
        lines.pop(0)
    turns: list[tuple[str, list[str]]] = []
    for line, s in zip(lines, model.viterbi(observe(lines))):
        role, kind = STATES[s]
        if kind == "begin" and line.strip():
            cls, width = marker(line)
            turns.append((role, [line[width:] if cls == 1 + ROLES.index(role) else line]))
        elif turns:
            turns[-1][1].append(line)
        else:
            turns.append((role, [line]))
    return [(r, "\n".join(t).strip("\n")) for r, t in turns]


_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", re.DOTALL)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{r}|>\n{_OPEN.sub(lambda m: f'<{chr(92)}{m[1]}|', t)}\n<|end|>\n" for r, t in turns)


def unrender(chat: str) -> list[tuple[str, str]]:
    """The turns of a canonical rendering."""
    return [(r, _SHUT.sub(lambda m: f"<{m[1]}|", t)) for r, t in _TURN.findall(chat)]


def train_roles(known: DataFrame) -> RoleModel:
    """Counts over (transcript, line_roles, line_begins): a transcript with the role of each line and whether it begins a turn."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, move = np.zeros(len(STATES)), np.zeros((len(STATES), len(STATES)))
        emit = [np.zeros((len(STATES), n)) for _, n in FEATURES]
        for b in batches:
            for text, roles, begins in zip(b["transcript"], b["line_roles"], b["line_begins"]):
                if not text:
                    continue
                lines = text.split("\n")
                if len(roles) != len(lines) or any(r not in ROLES for r in roles):
                    continue
                s = np.array([_INDEX[r, "begin" if x else "inside"] for r, x in zip(roles, begins)])
                obs = observe(lines)
                start[s[0]] += 1
                np.add.at(move, (s[:-1], s[1:]), 1)
                for f, t in enumerate(emit):
                    np.add.at(t, (s, obs[:, f]), 1)
        rows = [(0, i, 0, x) for i, x in enumerate(start)] + [(1, i, j, move[i, j]) for i in range(len(STATES)) for j in range(len(STATES))]
        rows += [(2 + f, i, j, t[i, j]) for f, t in enumerate(emit) for i in range(len(STATES)) for j in range(t.shape[1])]
        yield pd.DataFrame([r for r in rows if r[3]], columns=["part", "i", "j", "n"])

    start, move = np.zeros(len(STATES)), np.zeros((len(STATES), len(STATES)))
    emit = [np.zeros((len(STATES), n)) for _, n in FEATURES]
    counts = known.select("transcript", "line_roles", "line_begins").mapInPandas(count, "part int, i int, j int, n double")
    for r in counts.groupBy("part", "i", "j").agg(F.sum("n").alias("n")).collect():  # a few hundred cells, whatever the input
        if r["part"] == 0:
            start[r["i"]] = r["n"]
        elif r["part"] == 1:
            move[r["i"], r["j"]] = r["n"]
        else:
            emit[r["part"] - 2][r["i"], r["j"]] = r["n"]
    return RoleModel(start, move, emit)


def format_chats(transcripts: DataFrame, model: RoleModel, key: str = "conv_id") -> DataFrame:
    """key, n_turns, roles, texts and chat (the canonical rendering), one row per input row."""
    tables = transcripts.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("roles array<string>, texts array<string>, chat string")
    def run(col: pd.Series) -> pd.DataFrame:
        turns = [parse(t, tables.value) for t in col]
        return pd.DataFrame({"roles": [[r for r, _ in t] for t in turns], "texts": [[x for _, x in t] for t in turns], "chat": [render(t) for t in turns]})

    return transcripts.select(key, run("transcript").alias("__c")).select(key, F.size("__c.roles").alias("n_turns"), "__c.roles", "__c.texts", "__c.chat")


STYLES = (
    {"user": "User: ", "assistant": "Assistant: ", "system": "System: "},
    {"user": "Human: ", "assistant": "AI: ", "system": "Context: "},
    {"user": "**Q**: ", "assistant": "**A**: ", "system": "**System**: "},
    {"user": "### Instruction:\n", "assistant": "### Response:\n", "system": "### System:\n"},
    {"user": "[customer] ", "assistant": "[agent] ", "system": "[system] "},
    {"user": "<|user|> ", "assistant": "<|assistant|> ", "system": "<|system|> "},
)
UNMARKED = 16


def transcripts_of(conversations: DataFrame) -> DataFrame:
    """conv_id, transcript, line_roles, line_begins and truth (the roles): conversations as raw transcripts.

    The marker style follows a hash of the conversation; about one turn in UNMARKED has no marker, only a blank line
    before it. Turns of a conversation are in order of turn, then role and text; null text is an empty turn.
    """
    c = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"), F.xxhash64("conv_id").alias("h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, turns, h in zip(b["conv_id"], b["turns"], b["h"]):
                style, lines, roles, begins = STYLES[int(h) % len(STYLES)], [], [], []
                for k, t in enumerate(turns):
                    role = t["role"] if t["role"] in ROLES else "user"
                    bare = t["text"].strip() and (int(h) // 64 + 7 * k) % UNMARKED == 0
                    new = ([""] if bare and lines else []) + ((("" if bare else style[role]) + t["text"]).split("\n"))
                    begin = len(lines) + (1 if bare and lines else 0)
                    lines += new
                    roles += ([roles[-1]] if begin > len(lines) - len(new) else []) + [role] * (len(new) - (begin - (len(lines) - len(new))))
                    begins += [i == begin for i in range(len(lines) - len(new), len(lines))]
                out.append((conv, "\n".join(lines), roles, begins, [t["role"] for t in turns]))
            yield pd.DataFrame(out, columns=["conv_id", "transcript", "line_roles", "line_begins", "truth"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return c.mapInPandas(run, f"conv_id {kind}, transcript string, line_roles array<string>, line_begins array<boolean>, truth array<string>")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = materialize(transcripts_of(table(spark, sf_dir, "conversations")))
    return format_chats(t, train_roles(t))
