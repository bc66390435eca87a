"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; a dynamic programme
carries the best score and the number of pieces of the best path, nothing else. The rules are those of the
unigram tokenizer: a space becomes U+2581 and one is put before the text; a character that no single piece
covers costs the lowest score less ten and counts one piece per UTF-8 byte (or one per run of such characters
if the vocabulary has no byte pieces); of paths with equal score the one found first wins, starts in rising
order, so the last piece is the longest.

No piece reaches over the place before a run of U+2581 (checked when the vocabulary is read), nor over a line
feed, so the best path of a text is the best paths of its words in a row. Scores are summed in double
precision per word, and each distinct word is searched once per cache.

Defined cases: a null or empty text has 0 tokens; texts of any length are counted whole; repeated rows get the
same count; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.batches import Recent, free_name, short_batches

CACHE_ENTRIES = 300_000
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
NORMAL = 1


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The ordinary pieces and their scores, and whether bytes stand in for unknown characters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in every
              if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    return pieces, any(model.is_byte(i) for i in every)


class Counter:
    """Piece counts of texts under one vocabulary; keeps the counts of recent words."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        words = not any(re.search(f"[^{SPACE}]{SPACE}|\n", piece) for piece, _ in pieces)
        # A run of unknown characters may pass a line feed, so without byte pieces only spaces part words.
        split = r" *[^ \n]+| +|\n" if byte_fallback else r" *[^ ]+| +"
        self.words = re.compile(split if words else r"(?s).+").findall
        self.recent = Recent(lambda word: self.search(word.replace(" ", SPACE)), CACHE_ENTRIES)

    def search(self, text: str) -> int:
        """Pieces of the best path of ``text``, whose spaces are mapped."""
        matches: list[list[tuple[int, float]]] = [[] for _ in text]
        for end, (length, score) in self.automaton.iter(text):
            matches[end].append((length, score))
        scores, counts, unknown_end = [0.0], [0], [False]
        for end, character in enumerate(text):
            best, count, unknown = None, 0, False
            found = matches[end]
            if len(found) > 1:
                found.sort(reverse=True)
            for length, score in found:
                score += scores[end + 1 - length]
                if best is None or score > best:
                    best, count = score, counts[end + 1 - length] + 1
            if character not in self.single:
                score = scores[end] + self.unknown
                if best is None or score > best:
                    best, unknown = score, True
                    if self.byte_fallback:
                        count = counts[end] + len(character.encode())
                    else:
                        count = counts[end] + (not unknown_end[end])
            scores.append(best)
            counts.append(count)
            unknown_end.append(unknown)
        return counts[-1]

    def count(self, text: str) -> int:
        return sum(map(self.recent.__getitem__, self.words(" " + text))) if text else 0


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per worker process."""
    return Counter(*read_vocabulary(path))


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of pieces of every whole text, without a shuffle.

    The new column comes last; its name is lengthened where it clashes.
    """

    short_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def count(texts):
        own = counter(path)
        return texts.map(lambda text: own.count(text or "")).astype("int64")

    return docs.withColumn(free_name(docs.columns, count_col), count(F.col(f"`{text_col}`")))


def op10_token_count(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole document under the 32,000-piece vocabulary, read as a unigram model."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")
