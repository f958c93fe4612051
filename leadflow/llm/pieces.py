"""The vocabulary of a SentencePiece merge-type (BPE) model, as operators 2 and 3 use it.

Both cut a text into chunks that no merge can cross, and work per distinct chunk:
a chunk is a run of the space mark with the text after it, or a line break (which
is no piece and so is spelled in bytes).
"""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece

SPACE = "▁"
_CHUNK = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


class Pieces:
    """Scores and ids of the pieces; made once per Python worker and model."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        for i in range(len(m)):
            if m.is_byte(i):
                self.byte_ids[int(m.id_to_piece(i)[1:-1], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.ids[m.id_to_piece(i)] = i
        # Merges go by descending score; equal ranks mean equal scores.
        self.rank = {p: -m.get_score(i) for p, i in self.ids.items()}
        self.end_id = m.eos_id()
        # The cutting into chunks rests on these.
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in self.ids):
            raise ValueError(f"{path}: a piece holds a space or line break after other text")

    def spelled(self, char: str) -> list[int]:
        """Ids of a character that is no piece: its UTF-8 bytes."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def chunks(text: str) -> list[str]:
    """Independent chunks of a text, spaces marked and one mark put in front."""
    return _CHUNK.findall(SPACE + text.replace(" ", SPACE)) if text else []


class Memo(dict):
    """Results per distinct chunk, of bounded size: when half full, what it holds is set aside,
    and of what was set aside before, only chunks that came back meanwhile stay. Long chunks,
    which hardly return, are worked out each time."""

    LIMIT = 300_000
    LONGEST = 64

    def __init__(self, make, limit: int = LIMIT) -> None:
        super().__init__()
        self.make = make
        self.limit = limit
        self.aside: dict = {}

    def __missing__(self, chunk: str):
        if (out := self.aside.get(chunk)) is None:
            out = self.make(chunk)
        if len(chunk) <= self.LONGEST:
            if len(self) >= self.limit // 2:
                self.aside = dict(self)
                self.clear()
            self[chunk] = out
        return out
