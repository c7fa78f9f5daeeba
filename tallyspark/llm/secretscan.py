"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Base findings come from three patterns (assign, access, hex).  Candidates are all runs of
`[A-Za-z0-9+/_=.-]` without the base findings in them, of MIN_RUN characters or more; the network
reads each whole candidate with CONTEXT characters on both sides and gives a probability.

The network is small (embedding, one convolution, maximum and mean over positions, one linear
layer) and is trained on the labelled findings of all documents, whole: base findings and runs without
any, made-up keys and harmless runs, and compounds of the corpus's words.  The driver only gives it
starting weights (START_FINDINGS of each class, values of at most START_VALUE characters).  From
there on every finding of the corpus takes part: tasks pass over the findings of a part each in Adam
steps, the parts' weights are averaged, and the next pass begins there.
Runs of documents without a base finding count as harmless, so a secret of another shape that a
corpus holds in plain sight is learned as harmless.  Half of the positives get the surroundings of a
harmless run, so that the shape of the value counts and not only the name before it.  A value is held
out with all its copies.  Scores are calibrated by a logistic fit on all held-out findings, from their
counts by margin (steps of 1/GRID); the threshold is the highest step that keeps a recall of RECALL
there, whatever its height, and after the first pass over everything training goes on, for PASSES at
most, until no more than MAX_FALSE of all held-out real runs are marked at it.

Defined results: a null text is empty and holds nothing; whole texts of any length are searched;
repeated rows get equal results; an empty table gives an empty table (the made-up findings alone
then train the network); other columns pass through or are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrow import BATCH_ROWS, runs, share, shared, small_batches, strings, utf8
from tallyspark.llm.work import Workspace

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
MIN_RUN = 12
CONTEXT = 24
RECALL = 0.98
START_FINDINGS = 3000
START_VALUE = 200
HELD_OUT = 0.25
MAX_FALSE = 0.0005
EPOCHS, ROUNDS, BATCH = 12, 6, 128
PASSES, PASS_RATE, PASS_BATCH = 3, 0.002, 256
PASS_KEYS, PASS_PLAIN, PASS_EVERY = 64, 32, 16  # made-up examples for 512 findings; one of PASS_EVERY harmless runs is varied
PART_CHARS, MOST_PARTS = 8_000_000, 1000  # characters of findings in a part; a part is streamed, whatever its size
GRID, REACH = 1024, 64  # margins are counted in steps of 1/GRID, those beyond REACH at the ends
LONG = 1000  # values above are read in slices while training
WIDTH, FILTERS, EMBED = 5, 24, 8
SYMBOLS = 97  # padding, printable ASCII, everything else
CHARS = 100_000
SLICE = 50_000
MASK = "[SECRET]"
FOUND = "struct<starts: array<int>, ends: array<int>, kinds: array<int>>"


def char_ids() -> np.ndarray:
    """Symbol of each byte: 0 padding, 1-95 printable ASCII, 96 everything else."""
    table = np.full(256, 96, np.int64)
    table[32:127] = np.arange(1, 96)
    return table


def byte_class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


class Finder:
    """Base findings and candidate runs of a batch of texts, as code point spans."""

    def __init__(self):
        self.hex, self.run = byte_class("0123456789abcdef"), byte_class(ALNUM + "+/_=.-")

    def long_runs(self, table: np.ndarray, raw: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = runs(table[raw], offsets)
        long = ends - starts >= least
        return starts[long], ends[long]

    def find(self, column: pa.Array) -> Iterator[tuple[str, list[tuple[int, int, int]], list[tuple[int, int]]]]:
        """(text, base spans (start, end, kind), candidate spans) of each row."""
        raw, offsets = utf8(column)
        leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points that begin before each byte
        found = []
        for table, least in ((self.hex, MIN_HEX), (self.run, MIN_RUN)):
            starts, ends = self.long_runs(table, raw, offsets, least)
            firsts = np.searchsorted(starts, offsets)
            begin = leads[starts] - np.repeat(leads[offsets[:-1]], np.diff(firsts))
            found.append((begin.tolist(), (begin + ends - starts).tolist(), firsts.tolist()))
        for row, text in enumerate(strings(column)):

            def spans(which: int) -> list[tuple[int, int]]:
                starts, ends, firsts = found[which]
                return list(zip(starts[firsts[row]:firsts[row + 1]], ends[firsts[row]:firsts[row + 1]], strict=True))

            base = []
            if "=" in text or ":" in text:
                base += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
            if "AKIA" in text:
                base += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
            base += [(a, b, 2) for a, b in spans(0)]
            base.sort()
            yield text, base, cut_out(spans(1), base)


def cut_out(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base spans leave of spans, in pieces of MIN_RUN or more; both sorted by start."""
    out, at, reach = [], 0, 0
    for a, b in spans:
        start = max(a, reach)
        while at < len(base) and base[at][0] < b:
            if base[at][0] - start >= MIN_RUN:
                out.append((start, base[at][0]))
            reach = max(reach, base[at][1])
            start = max(start, reach)
            at += 1
        if b - start >= MIN_RUN:
            out.append((start, b))
    return out


@dataclass
class Net:
    """Convolution tables per offset (symbol x filters), biases, output weights, calibration, threshold."""

    tables: np.ndarray  # WIDTH x 2*SYMBOLS x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2*FILTERS
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0
    weights: dict[str, np.ndarray] | None = None  # as trained

    @classmethod
    def of(cls, w: dict[str, np.ndarray]) -> Net:
        tables = np.stack([w["embed"] @ w["conv"][j * EMBED:(j + 1) * EMBED] for j in range(WIDTH)])
        return cls(tables, w["bias"], w["out"], float(w["out_bias"][0]), weights=dict(w))

    def margins(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Raw outputs of windows laid end to end, each with WIDTH - 1 pads at its end."""
        hidden = self.hidden(ids)
        hidden[ids[:len(hidden)] == 0] = 0  # positions in the pads count for nothing
        lengths = np.diff(bounds) - WIDTH + 1
        top = np.maximum.reduceat(hidden, bounds[:-1])
        mean = np.add.reduceat(hidden, bounds[:-1]) / lengths[:, None]
        return np.concatenate([top, mean], axis=1) @ self.out + self.out_bias

    def hidden(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - WIDTH + 1
        hidden = np.broadcast_to(self.bias, (n, FILTERS)).copy()
        for j in range(WIDTH):
            hidden += self.tables[j][ids[j:j + n]]
        return np.maximum(hidden, 0, out=hidden)

    def long_margin(self, item: tuple[str, str, str], table: np.ndarray) -> float:
        """The raw output of one window, read in slices: a running maximum and sum."""
        top, total = np.zeros(FILTERS), np.zeros(FILTERS)
        rest = np.zeros(0, np.int64)
        for part, half in zip((*item, None), (0, SYMBOLS, 0, 0), strict=True):
            for at in range(0, 1 if part is None else len(part), SLICE):
                new = np.zeros(WIDTH - 1, np.int64) if part is None else codes(part[at:at + SLICE], table) + half
                ids = np.concatenate([rest, new])
                if len(ids) >= WIDTH:
                    hidden = self.hidden(ids)
                    top, total = np.maximum(top, hidden.max(axis=0)), total + hidden.sum(axis=0)
                rest = ids[-(WIDTH - 1):]
        return float(np.concatenate([top, total / sum(map(len, item))]) @ self.out + self.out_bias)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -50, 50)))

    def scores(self, items: list[tuple[str, str, str]], table: np.ndarray) -> list[float]:
        """Calibrated probabilities."""
        return self.probability(self.all_margins(items, table)).tolist()

    def all_margins(self, items: list[tuple[str, str, str]], table: np.ndarray) -> np.ndarray:
        """Raw outputs, computed for some CHARS of windows at a time."""
        margins = np.zeros(len(items))
        held: list[int] = []
        size = 0
        for k, item in enumerate(items):
            if len(item[1]) > SLICE:
                margins[k] = self.long_margin(item, table)
                continue
            held.append(k)
            size += sum(map(len, item))
            if size >= CHARS:
                margins[held] = self.margins(*windows([items[x] for x in held], table))
                held, size = [], 0
        if held:
            margins[held] = self.margins(*windows([items[x] for x in held], table))
        return margins


class Adam:
    """Weights and their moments."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.steps = weights, rate, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for name, g in grads.items():
            self.first[name] = 0.9 * self.first[name] + 0.1 * g
            self.second[name] = 0.999 * self.second[name] + 0.001 * g * g
            self.weights[name] = self.weights[name] - self.rate * (self.first[name] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[name] / (1 - 0.999**self.steps)) + 1e-8)


def codes(text: str, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 255)]


def window_ids(left: str, value: str, right: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a candidate (second half of the alphabet) and its surroundings, then pads."""
    return np.concatenate([codes(left, table), codes(value, table) + SYMBOLS, codes(right, table), np.zeros(WIDTH - 1, np.int64)])


def windows(items: list[tuple[str, str, str]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [window_ids(*x, table) for x in items]
    return np.concatenate([*parts, np.zeros(WIDTH - 1, np.int64)]), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def surroundings(text: str, a: int, b: int) -> tuple[str, str, str]:
    return text[max(0, a - CONTEXT):a], text[a:b], text[b:b + CONTEXT]


def made_up(rng: np.random.Generator, n: int) -> tuple[list[str], list[str]]:
    """Keys of common shapes, and harmless runs of letters, digits, dots and hyphens."""
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    lower, upper, digit = ALNUM[26:52], ALNUM[:26], ALNUM[52:]
    word = lambda: pick("aeiou", 1) + "".join(pick("bcdfglmnprst", 1) + pick("aeiou", 1) for _ in range(rng.integers(1, 4)))
    keys = [lambda: pick(ALNUM, rng.integers(20, 64)), lambda: pick("0123456789abcdef", rng.integers(16, 64)), lambda: pick(upper + digit, rng.integers(16, 40)),
            lambda: pick(lower, 3) + "_" + pick(ALNUM, rng.integers(24, 40)), lambda: pick(lower, 2) + "-" + pick(ALNUM, rng.integers(24, 48)),
            lambda: pick(ALNUM + "+/", rng.integers(24, 80)) + "=", lambda: ".".join(pick(ALNUM + "_-", rng.integers(16, 32)) for _ in range(3)), lambda: pick(lower + digit, rng.integers(18, 40)),
            lambda: pick(lower + upper, rng.integers(12, 64)), lambda: pick(ALNUM, rng.integers(12, 20)), lambda: rng.choice(list("./-_")) + pick(ALNUM + "+/", rng.integers(20, 64))]
    plain = [lambda: f"mail{rng.integers(0, 99)}.{word()}.example.{pick(lower, 3)}", lambda: f"www.{word()}{rng.integers(0, 99)}.{word()}.com/{word()}",
             lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 12)}-{rng.integers(10, 28)}T{rng.integers(10, 24)}", lambda: "-".join(pick(digit, rng.integers(2, 5)) for _ in range(5)),
             lambda: f"{word()}-{word()}-{word()}-v{rng.integers(1, 20)}.{rng.integers(0, 9)}.{rng.integers(0, 9)}", lambda: f"{word()}/{word()}/{word()}_{rng.integers(0, 999)}.html",
             lambda: pick(digit, rng.integers(16, 24)), lambda: f"{word()}{word()}{word()}{rng.integers(0, 999)}", lambda: ".".join(str(rng.integers(0, 255)) for _ in range(5)),
             lambda: f"{word()}_{word()}_{word()}_{word()}{rng.integers(0, 9)}", lambda: f"{word()}.{word()}.{word()}{rng.integers(0, 99)}.{word()}",
             lambda: "".join(word() for _ in range(5)), lambda: "".join(word().capitalize() for _ in range(5)), lambda: pick("-=._", 1) * rng.integers(12, 60),
             lambda: f"{word()}-{word()}/{word()}-{word()}", lambda: f"{word()}.{word()}.{word()}_{word()}", lambda: f"{word()}_{word()}_{word()}".upper() + "_" + word().upper()]
    return [keys[k % len(keys)]() for k in range(n)], [plain[k % len(plain)]() for k in range(n)]


def fit(items: list[tuple[str, str, str]], labels: np.ndarray, held: np.ndarray, real: np.ndarray, seed: int = 7) -> Net:
    """Train on the items that are not ``held``; calibrate and set the threshold on those that are.

    The threshold keeps RECALL of the held-out secrets.  Training goes on, with the harmless items that
    the network still marks repeated, until it also marks no more than MAX_FALSE of the held-out ``real``
    harmless runs, or for ROUNDS rounds; the round with the fewest false marks is kept.
    """
    rng, table = np.random.default_rng(seed), char_ids()
    used = np.flatnonzero(~held)
    weights = {"embed": rng.normal(0, 0.3, (2 * SYMBOLS, EMBED)), "conv": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)),
               "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS), "out_bias": np.zeros(1)}
    adam, best, fewest = Adam(weights, 0.01), None, np.inf
    harmless = [items[r] for r in np.flatnonzero(held & real & (labels == 0))]
    for k in range(ROUNDS):
        for _ in range(EPOCHS if k == 0 else EPOCHS // 3):
            rng.shuffle(used)
            for at in range(0, len(used), BATCH):
                rows = used[at:at + BATCH]
                ids, bounds = windows([items[r] for r in rows], table)
                adam.step(gradients(weights, ids, bounds, labels[rows]))
        net = Net.of(weights)
        rows = np.flatnonzero(held)
        calibrate(net, net.margins(*windows([items[r] for r in rows], table)), labels[rows])
        marked = float(np.mean(np.array(net.scores(harmless, table)) >= net.threshold)) if harmless else 0.0
        if marked < fewest:
            best, fewest = net, marked
        if marked <= MAX_FALSE:
            break
        plain = np.flatnonzero(~held & (labels == 0))
        wrong = plain[np.array(net.scores([items[r] for r in plain], table)) >= net.threshold / 2]
        used = np.concatenate([used, np.repeat(wrong, 4)])
    return best


def gradients(w: dict[str, np.ndarray], ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    n, lengths = len(ids) - WIDTH + 1, (np.diff(bounds) - WIDTH + 1).astype(w["bias"].dtype)
    hidden = Net.of(w).hidden(ids)
    hidden[ids[:n] == 0] = 0
    top = np.maximum.reduceat(hidden, bounds[:-1])
    pooled = np.concatenate([top, np.add.reduceat(hidden, bounds[:-1]) / lengths[:, None]], axis=1)
    error = (1 / (1 + np.exp(-np.clip(pooled @ w["out"] + w["out_bias"], -50, 50))) - labels) / len(labels)
    back = error[:, None] * w["out"][None, :]
    owner = np.repeat(np.arange(len(lengths)), np.diff(bounds))
    # a maximum reached at several positions passes its gradient to each of them
    to_hidden = (back[:, :FILTERS][owner] * (hidden == top[owner]) + (back[:, FILTERS:] / lengths[:, None])[owner]) * (hidden > 0)
    embed, conv = spread_back(w, ids, to_hidden)
    return {"embed": embed + 1e-5 * w["embed"], "conv": conv + 1e-5 * w["conv"], "bias": to_hidden.sum(axis=0), "out": pooled.T @ error + 1e-5 * w["out"], "out_bias": np.array([error.sum()])}


def long_gradients(w: dict[str, np.ndarray], item: tuple[str, str, str], label: float, table: np.ndarray) -> dict[str, np.ndarray]:
    """``gradients`` of one window of any length, read in slices: first the pooled values, then what flows back."""
    net, length = Net.of(w), sum(map(len, item))
    ends = np.cumsum([0, *map(len, item)])

    def slices() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, length, LONG):
            cut = [codes(part[max(0, at - a):max(0, at + LONG + WIDTH - 1 - a)], table) + half for part, a, half in zip(item, ends, (0, SYMBOLS, 0), strict=False)]
            ids = np.concatenate(cut)
            n = min(LONG, length - at)  # positions that begin in the slice
            ids = np.concatenate([ids, np.zeros(n + WIDTH - 1 - len(ids), np.int64)])
            yield ids, net.hidden(ids)

    top, total = np.zeros(FILTERS), np.zeros(FILTERS)
    for _, hidden in slices():
        top, total = np.maximum(top, hidden.max(axis=0)), total + hidden.sum(axis=0)
    pooled = np.concatenate([top, total / length])
    error = 1 / (1 + np.exp(-np.clip(pooled @ w["out"] + w["out_bias"][0], -50, 50))) - label
    back = error * w["out"]
    grads = {k: 1e-5 * v if k in ("embed", "conv", "out") else np.zeros_like(v) for k, v in w.items()}
    grads["out"], grads["out_bias"] = grads["out"] + error * pooled, np.array([error])
    for ids, hidden in slices():
        to_hidden = (back[:FILTERS] * (hidden == top) + back[FILTERS:] / length) * (hidden > 0)
        embed, conv = spread_back(w, ids, to_hidden)
        grads["embed"], grads["conv"], grads["bias"] = grads["embed"] + embed, grads["conv"] + conv, grads["bias"] + to_hidden.sum(axis=0)
    return grads


def spread_back(w: dict[str, np.ndarray], ids: np.ndarray, to_hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the embedding and of the convolution: what flows back, summed by offset and symbol."""
    n, width = len(to_hidden), len(w["embed"])
    embed, conv = np.zeros_like(w["embed"]), np.zeros_like(w["conv"])
    order = np.argsort(ids[:n + WIDTH - 1].astype(np.uint8), kind="stable")
    for j in range(WIDTH):
        at = order - j
        at = at[(at >= 0) & (at < n)]
        symbols = ids[at + j]
        starts = np.flatnonzero(np.diff(symbols, prepend=-1))
        sums = np.zeros((width, to_hidden.shape[1]), to_hidden.dtype)
        sums[symbols[starts]] = np.add.reduceat(to_hidden[at], starts, axis=0)
        rows = slice(j * EMBED, (j + 1) * EMBED)
        embed += sums @ w["conv"][rows].T
        conv[rows] = w["embed"].T @ sums
    return embed, conv


def batch_gradients(w: dict[str, np.ndarray], items: list[tuple[str, str, str]], labels: np.ndarray, table: np.ndarray) -> dict[str, np.ndarray]:
    """``gradients`` of a batch with values of any length."""
    long = np.array([len(v) > LONG for _, v, _ in items])
    short = np.flatnonzero(~long)
    parts = [(1, long_gradients(w, items[k], labels[k], table)) for k in np.flatnonzero(long)]
    if len(short):
        parts.append((len(short), gradients(w, *windows([items[k] for k in short], table), labels[short])))
    return {name: (sum(n * g[name] for n, g in parts) / len(items)).astype(w[name].dtype) for name in w}


def calibrate(net: Net, margins: np.ndarray, labels: np.ndarray) -> None:
    calibrate_counts(net, margins, labels, np.ones(len(margins)))


def calibrate_counts(net: Net, margins: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> None:
    """Logistic fit of labels on margins that come ``counts`` times, by Newton steps with a small ridge; then the threshold."""
    x, beta = np.stack([margins, np.ones_like(margins)], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        grad = x.T @ (counts * (p - labels)) + 1e-1 * (beta - [1.0, 0.0])
        beta = beta - np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(2), grad)
    net.slope, net.shift = float(max(beta[0], 1e-3)), float(beta[1])
    p, times = net.probability(margins[labels == 1]), counts[labels == 1]
    order = np.argsort(p, kind="stable")
    upto = np.cumsum(times[order])
    allowed = int(times.sum() * (1 - RECALL))  # positives that may fall below the threshold
    net.threshold = float(p[order[np.searchsorted(upto, allowed, "right")]]) if len(p) else 0.5


def findings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All base findings (y = 1) and harmless runs (y = 0) with their surroundings, each distinct one once."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            rows = []
            for text, base, other in finder.find(batch.column(0)):
                edges = {x for a, b, _ in base for x in (a, b)}
                for a, b, kind in base:
                    if kind == 0:
                        a, b = ASSIGN.match(text, a).span(2)
                    rows.append((*surroundings(text, a, b), 1))
                # what is left beside a base finding may be the rest of a secret, so it is no example
                rows += [(*surroundings(text, a, b), 0) for a, b in other if a not in edges and b not in edges]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k < 3 else pa.int32()) for k in range(4)], ["l", "v", "r", "y"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(cut, "l string, v string, r string, y int").distinct()


def labelled(found: DataFrame, most: int = START_FINDINGS) -> tuple[list, list]:
    """The findings and harmless runs that give the network its starting weights."""
    get = lambda y: sorted(tuple(r)[:3] for r in found.where((F.col("y") == y) & (F.length("v") <= START_VALUE)).orderBy(F.xxhash64("l", "v", "r"), "l", "v", "r").limit(most).collect())
    return get(1), get(0)


def compounds(rng: np.random.Generator, words: list[str], n: int) -> list[str]:
    """Harmless runs of letters, made of words that stand around the findings."""
    out = []
    for k in range(n if words else 0):
        run = "".join(rng.choice(words, rng.integers(2, 5)))
        out.append((run, run.lower(), run.capitalize(), run.upper())[k % 4])
    return [x for x in out if len(x) >= MIN_RUN]


def is_held(value: str) -> bool:
    return zlib.crc32(value.lower().encode("utf-8", "surrogatepass")) % 100 < 100 * HELD_OUT


def train(docs: DataFrame, seed: int = 7) -> Net:
    """Values, and with them all their copies, are held out as a whole (HELD_OUT of them, by hash)."""
    work = Workspace(docs.sparkSession, "secrets")
    found = work.save(findings(docs), "findings")
    positive, negative = labelled(found)
    rng = np.random.default_rng(seed)
    keys, plain = made_up(rng, 1200)
    around = [(left, right) for left, _, right in negative] or [("the value is ", " and so on")]
    other = lambda: around[rng.integers(0, len(around))]
    place = lambda values: [(a, v, b) for v in values for a, b in [other()]]
    words = sorted({w for a, _, b in negative for w in re.findall("[A-Za-z]{3,}", f"{a} {b}")})
    made = place([v for _, v, _ in positive[::2]]), place(keys)
    secret = [*positive, *made[0], *made[1]]
    harmless = [*negative, *place(v.upper() for _, v, _ in negative[::4]), *place(compounds(rng, words, 1200)), *(plain := place(plain))]
    items = [*secret, *harmless]
    held = np.array([is_held(v) for _, v, _ in items])
    real = np.arange(len(items)) < len(secret) + len(negative)
    net = fit(items, (np.arange(len(items)) < len(secret)).astype(float), held, real, seed)
    net = train_on_all(net, found, made[1], plain)
    work.drop(found)
    return net


def varied(items: list[tuple[str, str, str]], labels: list[int], held: bool, rng: np.random.Generator) -> tuple[list[tuple[str, str, str]], list[int]]:
    """Half of a batch's secrets in other surroundings, some of its harmless runs in capitals, and compounds of its words."""
    secret, plain = ([x for x, y in zip(items, labels, strict=True) if y == z] for z in (1, 0))
    some, around = plain[::PASS_EVERY], plain or [("the value is ", "", " and so on")]
    words = sorted({w for a, _, b in some for w in re.findall("[A-Za-z]{3,}", f"{a} {b}")})
    values = [(v, 1) for _, v, _ in secret[::2]] + [(v.upper(), 0) for _, v, _ in some] + [(v, 0) for v in compounds(rng, words, len(some)) if is_held(v) == held]
    places = [around[k] for k in rng.integers(0, len(around), len(values))]
    return [(a, v, b) for (v, _), (a, _, b) in zip(values, places, strict=True)], [y for _, y in values]


def train_on_all(net: Net, found: DataFrame, keys: list[tuple[str, str, str]], plain: list[tuple[str, str, str]]) -> Net:
    """Passes over every finding that is not held out; calibration and threshold on every one that is.

    ``found`` is a written table.  A part's rows come in the order of a hash and are streamed, so the parts' weights
    depend on the rows alone.
    """
    chars = found.agg(F.sum(F.length("l") + F.length("v") + F.length("r"))).first()[0]
    if not chars:
        return net
    spark, parts = found.sparkSession, min(math.ceil(chars / PART_CHARS), MOST_PARTS)
    small_batches(spark)
    dealt = found.repartition(parts, "l", "v", "r").sortWithinPartitions(F.xxhash64("l", "v", "r"), "l", "v", "r", "y").persist(StorageLevel.DISK_ONLY)
    extra = [x for x in (*keys, *plain) if is_held(x[1])]
    is_key = np.arange(len(extra)) < sum(is_held(v) for _, v, _ in keys)
    best, fewest, weights = None, np.inf, net.weights
    try:
        for k in range(PASSES):
            weights = one_pass(dealt, weights, keys, plain, k)
            net = Net.of(weights)
            with shared(spark, net) as model:
                rows = dealt.mapInArrow(margin_counts(model), "y int, real boolean, step int, n long").groupBy("y", "real", "step").agg(F.sum("n").alias("n")).orderBy("y", "real", "step").collect()
            steps = np.concatenate([[r.step for r in rows], margin_steps(net.all_margins(extra, char_ids()))])
            labels = np.concatenate([[r.y for r in rows], is_key]).astype(float)
            counts = np.concatenate([[r.n for r in rows], np.ones(len(extra))])
            calibrate_counts(net, steps / GRID, labels, counts)
            runs_held = np.array([r.real and not r.y for r in rows] + [False] * len(extra), bool)
            marked = float(counts[runs_held & (net.probability(steps / GRID) >= net.threshold)].sum() / max(counts[runs_held].sum(), 1))
            if marked < fewest:
                best, fewest = net, marked
            if marked <= MAX_FALSE:
                break
    finally:
        dealt.unpersist()
    return best


def one_pass(dealt: DataFrame, weights: dict[str, np.ndarray], keys: list[tuple[str, str, str]], plain: list[tuple[str, str, str]], number: int) -> dict[str, np.ndarray]:
    """The mean, by findings, of the weights that the parts reach from the given ones."""
    keys, plain = ([x for x in some if not is_held(x[1])] for some in (keys, plain))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (start, keys, plain) = char_ids(), given()
        adam, seen = Adam({k: v.astype(np.float32) for k, v in start.items()}, PASS_RATE), 0
        for batch in batches:
            items, labels = rows_of(batch, False)
            if not items:
                continue
            seen += len(items)
            rng = np.random.default_rng([number, batch_seed(items)])
            drawn = [[some[k] for k in rng.integers(0, len(some), math.ceil(most * len(items) / BATCH_ROWS))] for some, most in ((keys, PASS_KEYS), (plain, PASS_PLAIN))]
            more, ys = varied(items, labels, False, rng)
            items += more + drawn[0] + drawn[1]
            targets = np.array(labels + ys + [1] * len(drawn[0]) + [0] * len(drawn[1]), np.float32)
            for some in np.array_split(rng.permutation(len(items)), math.ceil(len(items) / PASS_BATCH)):
                adam.step(batch_gradients(adam.weights, [items[k] for k in some], targets[some], table))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([pickle.dumps(adam.weights)], pa.binary())], ["n", "weights"])

    with shared(dealt.sparkSession, (weights, keys, plain)) as given:
        reached = [(r.n, pickle.loads(r.weights)) for r in dealt.mapInArrow(learn, "n long, weights binary").collect()]
    if not reached:
        return weights
    return {k: sum(n * w[k].astype(np.float64) for n, w in reached) / sum(n for n, _ in reached) for k in weights}


def batch_seed(items: list[tuple[str, str, str]]) -> int:
    return zlib.crc32("\n".join(items[0]).encode("utf-8", "surrogatepass"))


def rows_of(batch: pa.RecordBatch, held: bool) -> tuple[list[tuple[str, str, str]], list[int]]:
    """Findings of a batch that are held out, or that are not, and their labels."""
    rows = [x for x in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True) if is_held(x[1]) == held]
    return [x[:3] for x in rows], [x[3] for x in rows]


def margin_steps(margins: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(margins, -REACH, REACH) * GRID).astype(np.int64)


def margin_counts(model: Callable[[], Net]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the held-out findings, and what is varied from them, by label and margin."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, table, counts = model(), char_ids(), Counter()
        for batch in batches:
            items, labels = rows_of(batch, True)
            if not items:
                continue
            more, ys = varied(items, labels, True, np.random.default_rng(batch_seed(items)))
            kinds = [(y, True) for y in labels] + [(y, False) for y in ys]
            counts.update((*kind, step) for kind, step in zip(kinds, margin_steps(net.all_margins(items + more, table)).tolist(), strict=True))
        columns = [*zip(*((*k, n) for k, n in counts.items()), strict=True)] or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.int32(), pa.int64()), strict=True)], ["y", "real", "step", "n"])

    return count


def all_spans(batch: pa.Array, finder: Finder, table: np.ndarray, net: Net) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, base spans and those the network adds, by start, then kind) of each row."""
    rows, asked, where = [], [], []
    for k, (text, base, other) in enumerate(finder.find(batch)):
        rows.append((text, base))
        asked += [surroundings(text, a, b) for a, b in other]
        where += [(k, a, b) for a, b in other]
    for (k, a, b), p in zip(where, net.scores(asked, table), strict=True):
        if p >= net.threshold:
            rows[k][1].append((a, b, KINDS.index("model")))
    return [(text, sorted(spans, key=lambda s: (s[0], s[2]))) for text, spans in rows]


def secret_spans(docs: DataFrame, net: Net, text: Column) -> Column:
    """Column struct<starts, ends, kinds> of all spans of a text, by start, then kind."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = share(spark, net)

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder, table, model = Finder(), char_ids(), shared()
        for batch in batches:
            rows = [spans for _, spans in all_spans(batch, finder, table, model)]
            sizes = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            column = lambda j: pa.ListArray.from_arrays(sizes, pa.array([s[j] for r in rows for s in r], pa.int32()))
            yield pa.StructArray.from_arrays([column(0), column(1), column(2)], ["starts", "ends", "kinds"])

    return scan.asNondeterministic()(text)


def joined(spans: Column, base_only: bool) -> Column:
    """kind:start:end, comma-joined."""
    parts = F.transform(F.arrays_zip(spans["starts"], spans["ends"], spans["kinds"]),
                        lambda s: F.when(F.lit(not base_only) | (s["kinds"] < 3), F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kinds"] + 1), s["starts"], s["ends"])))
    return F.array_join(F.array_compact(parts), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model for every document."""
    net = train(docs)
    found = docs.select("doc_id", secret_spans(docs, net, F.col("text")).alias("_spans"))
    count = lambda kind: F.size(F.filter("_spans.kinds", lambda x: x == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(joined(F.col("_spans"), True), 256).alias("base_sha256"), joined(F.col("_spans"), False).alias("spans"), count(3).alias("n_model"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by MASK; spans that overlap share one."""
    parts, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            parts += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, net: Net, text: Column) -> Column:
    """The masked text where a text holds secrets, else null."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = share(spark, net)

    @F.arrow_udf("string")
    def replace(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder, table, model = Finder(), char_ids(), shared()
        for batch in batches:
            yield pa.array([masked(t, s) if s else None for t, s in all_spans(batch, finder, table, model)], pa.string())

    return replace.asNondeterministic()(text)


def base_sha256(spans: list[tuple[int, int, int]]) -> str:
    """The digest column of one text's base spans, for tests and readers outside Spark."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])) if k < 3).encode()).hexdigest()
