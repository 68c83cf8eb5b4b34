"""A sentencepiece BPE model read into plain tables, and texts cut where no merge can cross."""

from __future__ import annotations

import functools
import re

#: The visible space of sentencepiece.
BAR = "▁"


class Pieces:
    """Mergeable pieces of a BPE model with byte fallback: ids, scores and the ids of bytes.

    Texts are cut into segments that merges never cross. No mergeable piece has a bar after another
    character (checked here), so a cut may stand before each run of bars; a line feed is in no mergeable
    piece (checked too), so it is cut off as well.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.names) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        assert all(sp.is_byte(i) for i in self.byte), "a model with byte fallback is needed"
        assert not any(re.search(f"[^{BAR}]{BAR}", p) or "\n" in p for p in self.id), "pieces must not cross the cuts"
        #: What each id stands for in a decoded text, before the leading space goes.
        self.raw = [b"" if special[i] else p.replace(BAR, " ").encode() for i, p in enumerate(self.names)]
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])

    @staticmethod
    @functools.lru_cache(2)
    def of(model_file: str) -> Pieces:
        return Pieces(model_file)


_RUNS = re.compile(f"{BAR}+[^{BAR}\n]*|\n[^{BAR}\n]*")


def segments(text: str) -> list[str]:
    """Segments of the normalised text: a bar before it and bars for spaces; none for an empty text.

    A segment is a word with its one bar in front left out; a run of bars is written out, and a segment
    that starts with a line feed has no bar.
    """
    if not text:
        return []
    if "  " not in text and text[0] != " " and BAR not in text:
        return text.replace("\n", " \n").split(" ")
    whole = _RUNS.findall(BAR + text.replace(" ", BAR))
    return [s[1:] if s[0] == BAR and s[1:2] != BAR else s for s in whole]


def spelled(segment: str) -> str:
    """The symbols of a segment, as they stand in the normalised text."""
    return segment if segment[:1] in ("\n", BAR) and segment else BAR + segment
