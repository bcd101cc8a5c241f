"""Token counts of a unigram vocabulary by count-only Viterbi.

Aho-Corasick enumerates the vocabulary pieces that end at each character; dynamic programming carries only the best
score and its piece count from character to character.  Ties follow the tokenizer: of equal scores the piece that
begins first wins, and a character that is no piece by itself also competes as unknown, at the lowest score less ten.
An unknown character counts its bytes where the vocabulary has byte pieces; otherwise neighbours count as one.

Spaces become ``▁`` and a text gets one more in front.  Where no piece of the vocabulary holds ``▁`` after another
character, and ``▁`` is a piece or unknown characters count their bytes, a text falls into segments, each a run of ``▁`` and what follows, whose best paths are independent; a batch
counts each distinct segment once.  Otherwise a text is one segment.  Scores are added per segment in double precision.

The counts are those of the given scores read as a unigram vocabulary's.  No unigram file is at hand: the query reads
the piece file that there is, whose scores are the negated ranks of BPE merges, so its counts are exact under the
unigram rules but belong to no published tokenizer.  They were 14 % above the file's own library on 300 documents.

Edge cases
    null or empty text   no tokens
    very long text       counted whole; only a single segment is ever held as one string to search
    null id              carried through
    repeated rows, ties  every row is counted on its own
    empty table          empty result of the same columns
    extra columns        ignored by name
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pelagos.llm.words import bounded

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_CACHED = 200_000
_ROWS = 1024
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")


class SegmentCounter:
    """Token counts of segments under a vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool):
        import ahocorasick

        # pieces, or runs of unknown characters that count as one, may cross the boundaries of segments
        self.whole = any(SPACE in p.lstrip(SPACE) for p, _ in pieces) or (not byte_pieces and SPACE not in dict(pieces))
        self.matcher = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matcher.add_word(piece, (len(piece), float(score)))
        self.matcher.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_pieces, self.cache = byte_pieces, {}

    def count(self, segment: str) -> int:
        if self.whole:
            return self._best(segment)
        found = self.cache.get(segment)
        if found is None:
            if len(self.cache) >= _CACHED:
                self.cache.clear()
            found = self.cache[segment] = self._best(segment)
        return found

    def _best(self, text: str) -> int:
        best, count, lone = [0.0], [0], [False]  # lone: the best path here ends with an unknown character
        whole, size, strange = False, len(text), self.unknown

        def close() -> None:
            """Ends the current character, once all pieces that end there have been seen."""
            at = len(best) - 1
            if not whole and (best[at] is None or best[at - 1] + strange > best[at]):
                best[at] = best[at - 1] + strange
                more = len(text[at - 1].encode()) if self.byte_pieces else not lone[at - 1]
                count[at], lone[at] = count[at - 1] + more, True

        for end, (length, score) in self.matcher.iter(text):
            while len(best) <= end + 1:
                if len(best) > 1:
                    close()
                best.append(None)
                count.append(0)
                lone.append(False)
                whole = False
            whole = whole or length == 1
            score += best[end + 1 - length]
            if best[-1] is None or score > best[-1]:
                best[-1], count[-1], lone[-1] = score, count[end + 1 - length] + 1, False
        while True:
            if len(best) > 1:
                close()
            if len(best) > size:
                return count[size]
            best.append(None)
            count.append(0)
            lone.append(False)
            whole = False


def segments(text: str, whole: bool = False) -> list[str]:
    if not text:
        return []
    text = SPACE + text.replace(" ", SPACE)
    return [text] if whole else _SEGMENT.findall(text)


@functools.lru_cache(maxsize=2)
def piece_file_counter(model_file: str) -> SegmentCounter:
    """Counter over the pieces and scores of a SentencePiece file, built once in each Python worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in plain]
    return SegmentCounter(pieces, any(model.is_byte(i) for i in ids))


def _batch_counts(texts: pa.Array, counter: SegmentCounter) -> np.ndarray:
    """Tokens of each text; texts of single spaces take the vectorised path, which gives the same segments."""
    texts = pc.fill_null(texts, "")
    odd = np.asarray(pc.match_substring_regex(texts, f"  |{SPACE}|^ | $|^$")).astype(bool) | counter.whole
    made = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(odd).tolist():
        made[i] = sum(map(counter.count, segments(texts[i].as_py(), counter.whole)))
    plain = np.flatnonzero(~odd)
    if len(plain):
        lists = pc.split_pattern(texts.take(pa.array(plain)).cast(pa.large_string()), " ")
        coded = pc.list_flatten(lists).dictionary_encode()
        own = np.array([counter.count(SPACE + w) for w in coded.dictionary.to_pylist()], np.int64)
        sums = np.concatenate([[0], np.cumsum(own[np.asarray(coded.indices)])])
        made[plain] = np.diff(sums[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])])
    return made


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and n_tokens."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_file_counter(model_file)
        for batch in bounded(batches, 1, _ROWS):
            made = _batch_counts(batch.column(1), counter)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["id", "n_tokens"])

    return rows.mapInArrow(counted, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long")
