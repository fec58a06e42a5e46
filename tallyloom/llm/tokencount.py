"""Token counts of a byte-pair piece model by finite-state transducers.

A token sequence is the model's own if each pair of neighbours is: joined and cut by the model's
merges, the two come out again. So a walk through a text needs to know of the past only, for every
place from which a piece may still be growing, the trie node that has been reached and the token
before that place. These pairs are the states of an unambiguous transducer; sets of them, each with
the tokens it is ahead, are the states of the deterministic one, whose transitions are annotated
with the number of tokens they emit. Its transitions are compiled when a text first needs them.

No piece of the usual models has a word sign behind another character, so every word starts in the
same state and is counted by one run. An unbroken run of characters beyond ``FRAGMENT`` is cut. A
fragment gives a state map: for every state in which it can be entered, the states in which it ends
and the tokens emitted. Maps compose associatively; Spark composes neighbours in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import chunks, keep, plain

WORD_SIGN = "▁"
#: Characters of one fragment of an unbroken run.
FRAGMENT = 4096
#: Maps composed by one step of the tree.
FAN = 16
#: Compiled transitions, judged pairs and counted words a worker remembers before it starts afresh.
TRANSITIONS, PAIRS, WORDS = 1_000_000, 1_000_000, 600_000
#: A fragment's runs are compared, and equal ones merged, after so many characters.
STRIDE = 64
#: A transition is one number: the next state, and below it in SHIFT bits the tokens emitted.
SHIFT = 16
LOW = (1 << SHIFT) - 1
ROOT, ANY = 0, 0
COLUMNS = (
    "row bigint, doc_id bigint, n_bytes bigint, unit int, frag int, "
    "map array<struct<a: bigint, b: bigint, n: bigint>>"
)


def pieces_of(path: str) -> dict[str, float]:
    """The pieces that merges can make, with their scores.

    Only models whose normalization leaves characters as they are and that have no pieces of the
    user's own are compiled; others raise ValueError.
    """
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    raw = SentencePieceProcessor(model_file=path).serialized_model_proto()
    model = sentencepiece_model_pb2.ModelProto.FromString(raw)
    norm, kind = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    plain_text = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
        raise ValueError(f"{path}: not a byte-pair model with bytes for unknown characters")
    if norm.precompiled_charsmap or not plain_text or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: its normalization changes more than spaces")
    if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
        raise ValueError(f"{path}: user-defined or unused pieces")
    return {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}


class Transducer:
    """The deterministic transducer of one model, compiled as far as texts have needed it."""

    def __init__(self, pieces: dict[str, float]):
        self.scores = pieces
        self.pieces = ["", *pieces]
        self.longest = max(map(len, pieces), default=1)
        self.children: list[dict[str, int]] = [{}]
        self.token = [0]
        for number, piece in enumerate(self.pieces[1:], 1):
            node = ROOT
            for c in piece:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token.append(0)
                node = self.children[node][c]
            self.token[node] = number
        self.numbers = {p: i for i, p in enumerate(self.pieces) if i}
        self.known = {c for c in pieces if len(c) == 1}
        #: whether every word sign behind another character starts a run of its own
        self.by_word = not any(WORD_SIGN in p.lstrip(WORD_SIGN) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.final: list[int | None] = []
        self.pairs: dict[tuple[int, int], bool] = {}
        self.histories: dict[int, list[tuple[float, str, str]] | None] = {}
        self.compiled = 0
        self.start = self.state(((ROOT, ANY, 0),))
        self.dead = self.state(())

    def state(self, content: tuple) -> int:
        number = self.states.get(content)
        if number is None:
            number = self.states[content] = len(self.content)
            self.content.append(content)
            self.moves.append({})
            self.final.append(next((ahead for node, _, ahead in content if node == ROOT), None))
        return number

    def history(self, token: int) -> list[tuple[float, str, str]] | None:
        """The merges that make the piece (best score first, leftmost of equals), each with the
        first and last part after it; None if merges cut its text otherwise."""
        if token not in self.histories:
            parts, done = list(self.pieces[token]), []
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    score = self.scores.get(parts[i] + parts[i + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                done.append((best, parts[0], parts[-1]))
            self.histories[token] = done if len(parts) == 1 else None
        return self.histories[token]

    def fits(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last``; ANY stands for a border that no merge crosses."""
        ok = self.pairs.get((last, token))
        if ok is None:
            ok = self.pairs[last, token] = self.apart(last, token)
        return ok

    def apart(self, last: int, token: int) -> bool:
        """Whether the merges of both pieces, in their common order, end without one across."""
        right = self.history(token)
        left = [] if last == ANY else self.history(last)
        if right is None or left is None:
            return False
        if last == ANY:
            return True
        x, y = self.pieces[last][-1], self.pieces[token][0]
        i = j = 0
        while True:
            own = left[i][0] if i < len(left) else None
            other = right[j][0] if j < len(right) else None
            across = self.scores.get(x + y)
            if across is not None and (own is None or across > own) and (other is None or across >= other):
                return False
            if own is not None and (other is None or own >= other):
                x = left[i][2]
                i += 1
            elif other is not None:
                y = right[j][1]
                j += 1
            else:
                return True

    def move(self, state: int, c: str) -> int:
        """Compile the transition: the next state and the tokens emitted, in one number."""
        out: dict[tuple[int, int], int] = {}
        if c in self.known:
            for node, last, ahead in self.content[state]:
                grown = self.children[node].get(c)
                if grown is None:
                    continue
                token = self.token[grown]
                if token and self.fits(last, token):
                    out[ROOT, token] = ahead + 1
                if self.children[grown]:
                    out[grown, last] = ahead
        else:  # no piece holds it: a token for each of its bytes, and a border on both sides
            ahead = self.final[state]
            if ahead is not None:
                out[ROOT, ANY] = ahead + len(c.encode("utf-8", "surrogatepass"))
        least = min(out.values(), default=0)
        after = self.state(tuple(sorted((node, last, n - least) for (node, last), n in out.items())))
        found = after << SHIFT | least
        self.moves[state][c] = found
        self.compiled += 1
        return found

    def run(self, state: int, text: str) -> tuple[int, int]:
        """The state after ``text`` and the tokens emitted on the way."""
        moves, total = self.moves, 0
        for c in text:
            step = moves[state].get(c)
            if step is None:
                step = self.move(state, c)
            state = step >> SHIFT
            total += step & LOW
        return state, total

    def count(self, text: str) -> int:
        """Tokens of a run between two borders."""
        state, total = self.run(self.start, text)
        return total + self.final[state]

    def entries(self, before: str, whole: bool) -> list[tuple[int, int]]:
        """All (node, last token) in which a text that goes on behind ``before`` can be entered.
        ``whole``: nothing stands before ``before``."""
        out = []
        for place in range(max(0, len(before) - self.longest + 1), len(before) + 1):
            node: int | None = ROOT
            for c in before[place:]:
                node = self.children[node].get(c)
                if node is None:
                    break
            if node is None or (node != ROOT and not self.children[node]):
                continue
            if (place == 0 and whole) or (place and before[place - 1] not in self.known):
                out.append((node, ANY))
                continue
            for size in range(1, min(place, self.longest) + 1):
                last = self.numbers.get(before[place - size : place])
                if last and self.fits(ANY, last):
                    out.append((node, last))
        return out

    def state_map(self, text: str, at: int, end: int) -> list[tuple[int, int, int]]:
        """(entry, exit, tokens) of the fragment from ``at`` to ``end`` of an unbroken run.

        Entries and exits are (node, last token) as one number; the borders of the run are 0.
        """
        context = 2 * self.longest
        before = text[max(0, at - context) : at]
        enter = self.entries(before, at <= context) if at else [(ROOT, ANY)]
        at_state: dict[int, list[tuple[int, int]]] = {}
        for node, last in enter:
            at_state.setdefault(self.state(((node, last, 0),)), []).append((node << 32 | last, 0))
        for cut in range(at, end, STRIDE):
            own, reached = text[cut : min(cut + STRIDE, end)], {}
            for state, runs in at_state.items():
                state, more = self.run(state, own)
                if state != self.dead:
                    reached.setdefault(state, []).extend((a, n + more) for a, n in runs)
            at_state = reached
        out = []
        for state, runs in at_state.items():
            if end == len(text):
                ends = [(0, self.final[state])] if self.final[state] is not None else []
            else:
                ends = [(node << 32 | last, ahead) for node, last, ahead in self.content[state]]
            out += [(a, b, n + ahead) for a, n in runs for b, ahead in ends]
        return out


class Counter:
    """Counts the texts of Arrow batches; one for each worker and model."""

    def __init__(self, path: str):
        self.machine = Transducer(pieces_of(path))
        self.words: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        """Tokens of a run; a line end that no piece holds is a border inside it."""
        if "\n" in word and "\n" not in self.machine.known:
            lines = word.split("\n")
            return len(lines) - 1 + sum(self.of_word(x) for x in lines if x)
        n = self.words.get(word)
        if n is None:
            n = self.words[word] = self.machine.count(word)
        return n

    def trim(self) -> None:
        if len(self.words) > WORDS:
            self.words = {}
        if self.machine.compiled > TRANSITIONS or len(self.machine.pairs) > PAIRS:
            self.machine.forget()

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Row and place in the list of different runs, of all runs of all texts."""
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = pc.binary_length(filled).to_numpy(zero_copy_only=False)
        if not self.machine.by_word:
            rows = np.flatnonzero(sizes)
            return rows, np.arange(len(rows)), [
                WORD_SIGN + t.replace(" ", WORD_SIGN) for t in filled.take(pa.array(rows)).to_pylist()
            ]
        parts = pc.split_pattern(pc.replace_substring(filled, WORD_SIGN, " "), " ")
        borders = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        values = coded.dictionary.to_pylist()
        borders -= borders[0]
        row = np.repeat(np.arange(len(texts)), np.diff(borders))
        empty = values.index("") if "" in values else -1
        full = np.flatnonzero(code != empty)
        # spaces before a word: its distance from the word before it or from the row's start
        before = np.empty(len(full), np.int64)
        before[1:] = full[:-1]
        if len(full):
            before[0] = -1
        signs = full - np.maximum(before, borders[row[full]] - 1)
        last = np.maximum.accumulate(np.where(code != empty, np.arange(len(code)), -1)) if len(code) else code
        ends = np.flatnonzero((sizes > 0) & (np.diff(borders) > 0))
        behind = borders[ends + 1] - 1 - np.maximum(last[borders[ends + 1] - 1], borders[ends] - 1)
        ends, behind = ends[behind > 0], behind[behind > 0]
        rows = np.concatenate([row[full], ends])
        keys = np.concatenate([signs * (len(values) + 1) + code[full], behind * (len(values) + 1) + len(values)])
        different, place = np.unique(keys, return_inverse=True)
        values.append("")
        runs = [WORD_SIGN * int(k // len(values)) + values[int(k % len(values))] for k in different]
        return rows, place, runs

    def batch(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        self.trim()
        rows, place, runs = self.units(texts)
        long = [i for i, r in enumerate(runs) if len(r) > FRAGMENT]
        sizes = np.array([0 if len(r) > FRAGMENT else self.of_word(r) for r in runs], np.int64)
        total = np.zeros(len(texts), np.int64)
        if len(rows):
            np.add.at(total, rows, sizes[place])
        n_bytes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        keys, docs = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
        out = [(keys[r], docs[r], n_bytes[r], -1, 0, [(0, 0, int(total[r]))]) for r in range(len(keys))]
        for i in long:
            maps = []
            for at in range(0, len(runs[i]), FRAGMENT):
                self.trim()
                maps.append(self.machine.state_map(runs[i], at, min(at + FRAGMENT, len(runs[i]))))
            for unit in np.flatnonzero(place == i):
                r = rows[unit]
                out += [(keys[r], docs[r], n_bytes[r], int(unit), frag, m) for frag, m in enumerate(maps)]
        cell = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(cell)]
        cells = [
            pa.array([x[:5][k] if k < 5 else [dict(zip("abn", y, strict=True)) for y in x[5]] for x in out], kinds[k])
            for k in range(6)
        ]
        return pa.RecordBatch.from_arrays(cells, ["row", "doc_id", "n_bytes", "unit", "frag", "map"])


COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter of the model, kept from task to task."""
    if path not in COUNTERS:
        COUNTERS[path] = Counter(path)
    return COUNTERS[path]


def composed(maps: Column) -> Column:
    """One state map out of an array of neighbouring ones: exits meet equal entries."""
    both = lambda x, y: F.struct(x["a"].alias("a"), y["b"].alias("b"), (x["n"] + y["n"]).alias("n"))
    met = lambda x, right: F.transform(F.filter(right, lambda y: y["a"] == x["b"]), lambda y: both(x, y))
    joined = lambda left, right: F.flatten(F.transform(left, lambda x: met(x, right)))
    return F.aggregate(F.slice(maps, 2, F.greatest(F.size(maps) - 1, F.lit(0))), maps[0], joined)


def count(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, as the piece model at ``path`` cuts its text.

    ``path`` names the model file on every machine. Null and empty texts have no tokens; repeated
    rows and rows without doc_id give a row each; an empty table gives no rows; columns other than
    doc_id and text are ignored, whatever their names. Texts are handled about 2 MB at a time, and
    a longer text alone. Composing takes one shuffle of the fragments' maps for each FAN-fold of the
    longest unbroken run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in chunks(batch, "text"):
                yield own.batch(part)

    own = plain(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    found = keep(own.mapInArrow(run, COLUMNS), "token-maps")
    fragments = found.filter("unit >= 0")
    last = fragments.agg(F.max("frag")).first()[0] or 0
    while last:
        near = F.array_sort(F.collect_list(F.struct("frag", "map")))
        group = ["row", "doc_id", "n_bytes", "unit", F.floor(F.col("frag") / FAN).cast("int").alias("frag")]
        fragments = fragments.groupBy(*group).agg(composed(F.transform(near, lambda x: x["map"])).alias("map"))
        last //= FAN
    # a row's own words and its unbroken runs meet once more, by the row
    tokens = F.col("map")[0]["n"]
    every = found.filter("unit < 0").unionByName(fragments)
    return (
        every.groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
        .drop("row")
    )
