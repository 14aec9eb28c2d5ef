"""Token counts without the tokens: a Viterbi search that carries score and piece count only."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words whose counts a worker remembers at once; it starts afresh beyond.
REMEMBER = 1_000_000
#: Characters from which on a text's words are listed one by one.
LONG = 1 << 20
#: The library's own: an unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0


class Counter:
    """Counts pieces of a unigram vocabulary [(piece, log probability)].

    The rules are those of the public unigram tokenizer with white space written as U+2581:
    each end position of the text takes the best-scored path; its candidates come by growing
    start, and a later one must be strictly better; a start from which no piece of one
    character begins adds an unknown piece for that character, with the worst score less 10;
    neighbouring unknown characters are one piece, or, with byte fallback, one piece a byte
    where all the bytes of the run are in the vocabulary.

    Aho-Corasick finds all pieces of a text in one pass. As pieces other than runs of U+2581
    hold that mark at their start only, no piece crosses from a word into the next one's mark,
    and a text is the sum of its words, whose counts are remembered.
    """

    def __init__(self, vocab: list[tuple[str, float]], unk_id: int | None = None, byte_fallback: bool = True):
        self.auto = ahocorasick.Automaton()
        best: dict[str, float] = {}
        for i, (piece, score) in enumerate(vocab):
            if piece and i != unk_id:
                best[piece] = score  # of a repeated piece the last stands, as in a map
        for piece, score in best.items():
            self.auto.add_word(piece, (len(piece), score))
        if best:
            self.auto.make_automaton()
        self.longest = max(map(len, best), default=1)
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in best for b in range(256))
        inner = any(SPACE in p[1:] and p.strip(SPACE) for p in best)
        self.unit = None if inner else re.compile(f"{SPACE}*[^{SPACE}]*")
        self.memo: dict[str, int] = {}
        self.empty = not best

    def count_unit(self, text: str) -> int:
        """Pieces of the best path over a text; what is kept goes back as far as the longest piece.

        Of equal scores the piece that starts first stands, as if paths were carried on from the left.
        """
        width = self.longest + 1
        score, count, open_ = [0.0] * width, [0] * width, [0] * width  # open_: pieces of the unknown run that is going on
        found = iter(()) if self.empty else self.auto.iter(text)
        end, match = next(found, (-1, None))
        for to in range(1, len(text) + 1):
            here = []
            while match is not None and end == to - 1:
                here.append(match)
                end, match = next(found, (-1, None))
            here.sort(key=_size, reverse=True)
            best = None
            for size, s in here:
                at = (to - size) % width
                new = score[at] + s
                if best is None or new > best:
                    best, pieces, run = new, count[at] + open_[at] + 1, 0
            if not here or here[-1][0] > 1:  # no piece is this character alone
                at = (to - 1) % width
                new = score[at] + self.unknown
                if best is None or new > best:
                    best, pieces = new, count[at]
                    run = open_[at] + len(text[to - 1].encode()) if self.bytes else 1
            at = to % width
            score[at], count[at], open_[at] = best, pieces, run
        at = len(text) % width
        return count[at] + open_[at]

    def count(self, text: str | None) -> int:
        """Pieces of a text: a mark before it, spaces as marks; null and empty text have none."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if self.unit is None:
            return self.count_unit(text)
        memo, total = self.memo, 0
        for w in self.unit.findall(text) if len(text) < LONG else map(_whole, self.unit.finditer(text)):
            n = memo.get(w)
            if n is None:
                if len(memo) >= REMEMBER:
                    memo.clear()
                n = self.count_unit(w)
                if len(w) < 64:
                    memo[w] = n
            total += n
        return total


def _size(match: tuple[int, float]) -> int:
    return match[0]


def _whole(match: re.Match) -> str:
    return match[0]


@lru_cache(maxsize=2)
def _counter(path: str | None) -> Counter:
    return Counter(*vocabulary(path))


def vocabulary(path: str | None = None) -> tuple[list[tuple[str, float]], int, bool]:
    """Pieces and scores of a sentencepiece model file: (vocab, unk_id, byte_fallback)."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    vocab = [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]
    return vocab, m.unk_id(), any(m.is_byte(i) for i in range(len(vocab)))


def count_tokens(docs: DataFrame, path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """doc_id and the number of tokens of each whole text, by the vocabulary at path.

    Null and empty texts have 0; null ids, repeated rows and other columns do no harm; an
    empty table gives no rows. No shuffle: each task counts the texts it reads.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c = _counter(path)
        for b in batches:
            n = []
            for at in range(0, b.num_rows, 500):
                n += map(c.count, b.column(1).slice(at, 500).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", out])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {id_type}, {out} long")
