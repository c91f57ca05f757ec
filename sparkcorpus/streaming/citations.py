"""Sentence citations `[n.m]` of an answer become chunk citations `[n]`, over a whole text or a stream."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from sparkcorpus.functions.arrow import arrow
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Characters of an open bracket that are waited for.
HOLD = 12
SENTENCE = re.compile(r"[\[⟨]\s*(\d{1,3})\s*[.．]\s*(\d{1,3})\s*[\]⟩]")
#: What a text falls into: plain stretches, closed brackets, brackets that stay open for too long, and an open one at the end.
PART = re.compile(rf"[^\[⟨]+|\[[^\]]{{0,{HOLD - 1}}}\]|⟨[^⟩]{{0,{HOLD - 1}}}⟩|\[[^\]]{{{HOLD}}}|⟨[^⟩]{{{HOLD}}}|(?P<tail>[\[⟨].*)", re.S)


class Transducer:
    """Takes pieces and gives what may be sent; an open bracket is held until it closes or is too long.

    `found` has (n, m, offset) for each rewritten citation, the offset being that of `[n]` in the output.
    """

    def __init__(self, held: str = "", sent: int = 0):
        self.held, self.sent, self.found = held, sent, []

    def feed(self, piece: str) -> str:
        text, self.held, out = self.held + piece, "", ""
        for part in PART.finditer(text):
            if part["tail"]:
                self.held = part["tail"]
            elif m := SENTENCE.fullmatch(part.group()):
                n = int(m[1])
                self.found.append((n, int(m[2]), self.sent + len(out)))
                out += f"[{n}]"
            else:
                out += part.group()
        self.sent += len(out)
        return out

    def flush(self) -> str:
        rest, self.held = self.held, ""
        self.sent += len(rest)
        return rest


def fix(text: str | None) -> dict:
    t = Transducer()
    out = t.feed(text or "")
    return {"text": out + t.flush(), "cites": [{"n": n, "m": m, "offset": o} for n, m, o in t.found]}


@arrow("struct<text:string,cites:array<struct<n:int,m:int,offset:int>>>")
def fix_citations(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([fix(t) for t in text], columns=["text", "cites"])


class CitationProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "held string, sent int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t = Transducer(*(self.state.get() or ("", 0)))
        out = []
        for frame in rows:
            for r in frame.sort_values("seq").itertuples():
                piece = t.feed(r.text) + (t.flush() if r.last else "")
                out.append((key[0], r.seq, piece))
        self.state.update((t.held, t.sent))
        yield pd.DataFrame(out, columns=["run", "seq", "text"])

    def close(self) -> None:
        pass


def fix_stream(stream: DataFrame) -> DataFrame:
    """Pieces (run, seq, text, last) of many runs, each rewritten across piece borders."""
    return stream.groupBy("run").transformWithStateInPandas(CitationProcessor(), "run string, seq long, text string", "Append", "none")
