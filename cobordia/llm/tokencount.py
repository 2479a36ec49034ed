"""Token counts under a unigram model, by trie-shared dynamic programming.

The model gives each piece of a public vocabulary a log-probability by its rank (Zipf's law: 1/rank, normalised);
characters outside of it cost one token per UTF-8 byte. A pre-token is the word-start mark and a word
(``[^\\x20\\x09-\\x0D]+``). Its best segmentation has the largest sum of log-probabilities, of equals the fewest tokens.

The forward score of a prefix depends on the prefix alone. So distinct pre-tokens go into a trie, whose nodes store the
prefix's forward score and token count: a node is computed once for all words that share the prefix, whichever block of
texts or task of a worker they come from. A word's last node has its terminal count, and documents sum the counts of
their words. New words of a block are entered in sorted order, so that the path of the word before is reused.

Workers keep the trie and the counts between blocks of texts up to ``NODES`` nodes and ``KEPT`` bytes of words and then
start afresh; words of more than ``DEEP`` characters are scored along one path, and neither it nor they are kept beyond
their block.

Defined cases: null and empty texts count 0; repeated rows count alike; very long words are one long path; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobordia.llm import textkernel as K
from cobordia.session import map_batches, table

MARK, BYTE_COST, NODES, KEPT, DEEP = "▁", 12.0, 1_000_000, 16 << 20, 64
SCHEMA = "doc_id long, n_words long, n_tokens long"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def unigrams(path: str) -> dict[str, float]:
    """Log-probability of each piece, by rank among the ordinary pieces of the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {piece: -log(r + 1) - total for r, piece in reversed(list(enumerate(pieces)))}


class Trie:
    """Forward scores of prefixes and terminal counts of pre-tokens, up to ``most`` nodes and ``kept`` bytes of words."""

    def __init__(self, scores: dict[str, float], most: int = NODES, kept: int = KEPT) -> None:
        self.scores, self.most, self.kept = scores, most, kept
        # pieces by last character: most ends of a word end no long piece
        self.lengths: dict[str, list[int]] = {}
        for piece in scores:
            self.lengths.setdefault(piece[-1], []).append(len(piece))
        self.lengths = {c: sorted(set(n)) for c, n in self.lengths.items()}
        self.clear()

    def clear(self) -> None:
        #: (node, character) -> node, as one number; node 0 is the root
        self.below: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.counts: dict[bytes, int] = {}
        self.long: list[bytes] = []
        self.bytes = 0

    def enter(self, words: list[str]) -> list[int]:
        """Terminal counts of the sorted ``words`` (with their marks)."""
        node, best, tokens, path, out = [0], [0.0], [0], "", []  # of the path's prefixes
        below, all_best, all_tokens, scores, lengths = self.below, self.best, self.tokens, self.scores, self.lengths
        for word in words:
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del node[shared + 1 :], best[shared + 1 :], tokens[shared + 1 :]
            at = node[-1]
            for end in range(shared + 1, len(word) + 1):
                last = word[end - 1]
                step = at << 21 | ord(last)
                at = below.get(step, -1) if at >= 0 else -1
                if at >= 0:
                    top, fewest = all_best[at], all_tokens[at]
                else:
                    size = 1 if last < "\x80" else len(last.encode())
                    top, fewest = best[-1] - BYTE_COST * size, tokens[-1] + size
                    for n in lengths.get(last, ()):
                        if n > end:
                            break
                        score = scores.get(word[end - n : end])
                        if score is not None:
                            score += best[end - n]
                            if score > top or (score == top and tokens[end - n] < fewest):
                                top, fewest = score, tokens[end - n] + 1
                    if end <= DEEP and step >= 0:
                        at = below[step] = len(all_best)
                        all_best.append(top)
                        all_tokens.append(fewest)
                node.append(at)
                best.append(top)
                tokens.append(fewest)
            out.append(tokens[-1])
            path = word
        return out

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.counts)
        if len(self.best) > self.most or self.bytes > self.kept:
            self.clear()
            new = words
        text = sorted((MARK + w.decode(), w) for w in new)
        self.counts.update(zip((w for _, w in text), self.enter([t for t, _ in text]), strict=True))
        self.long += (w for t, w in text if len(t) > DEEP)
        self.bytes += sum(map(len, new))

    def forget_long(self) -> None:
        """Drop the words beyond ``DEEP``, which have no terminal node; after each block."""
        for w in self.long:
            self.bytes -= len(w)
            del self.counts[w]
        self.long.clear()


def _count_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = K.held(f"tokens {path}", lambda: Trie(unigrams(path)))
        for batch in batches:
            n_words, n_tokens = [], []
            for _, _, data, offsets in K.blocks(batch.column(1)):
                raw = data.tobytes()
                docs = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                trie.learn(set().union(*docs))
                n_words += map(len, docs)
                n_tokens += [sum(map(trie.counts.__getitem__, d)) for d in docs]
                trie.forget_long()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return rows


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    return map_batches(docs.select(F.col(key).cast("long"), F.col(text)), _count_rows(path or model_path()), SCHEMA)


def op4_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op4_tokencount": op4_tokencount}
SQL: dict[str, str] = {}
