"""Personal data: exact patterns, and a semi-Markov conditional random field for other notations.

The field scores whole segments of tokens by features of the whole segment. A dynamic program
over segments of bounded length chooses boundaries and kinds together. It is trained on a bounded
sample of passages, in which the exact spans, and rewritten forms of them, are the truth.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candidata.cluster import written

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive, and never begun inside a run of digits: the same matches, in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What makes a passage worth a look: a digit, an at sign, or a spelt one.
TRIGGER = re.compile(r"[0-9@]|[\[({][\x20]?(?:at|dot)[\x20]?[\])}]", re.IGNORECASE)
TOKEN = re.compile(r"[\[({][\x20]?(?:at|dot)[\x20]?[\])}]|[A-Za-z0-9]+|[^\sA-Za-z0-9]", re.IGNORECASE)
CONTEXT, GAP, LONGEST = 40, 24, 30
#: Characters of an example for training that has no span.
PLAIN = 400

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum((2 * int(d)) % 10 + int(d) // 5 for d in digits[-2::-2])) % 10 == 0


def exact_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of each kind, in the order of KINDS, then of place."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            end = match.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def passages(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Disjoint stretches around triggers; none reaches into a taken span."""
    low = 0
    for start, end in [*sorted((s, e) for _, s, e in taken), (len(text), len(text))]:
        groups: list[list[int]] = []
        for m in TRIGGER.finditer(text, low, max(low, start)):
            if groups and m.start() - groups[-1][1] <= GAP:
                groups[-1][1] = m.end()
            else:
                groups.append([m.start(), m.end()])
        for k, (first, last) in enumerate(groups):
            stop = groups[k + 1][0] if k + 1 < len(groups) else start
            stop = min(stop, last + CONTEXT)
            yield max(low, first - CONTEXT), stop
            low = stop
        low = max(low, end)


def segment_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str] | None:
    """Features of tokens i..j as one span; None where a span cannot be."""
    start, end = tokens[i][0], tokens[j][1]
    span = text[start:end]
    if "\n" in span or not TRIGGER.search(span):
        return None
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    flat = re.sub(r"\s?[\[({]\s?dot\s?[\])}]\s?", ".", re.sub(r"\s?[\[({]\s?at\s?[\])}]\s?", "@", span, flags=re.I), flags=re.I)
    flat = flat.replace("[.]", ".")
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", flat))
    before = text[tokens[i - 1][0] : tokens[i - 1][1]].lower() if i else "^"
    touches = (i > 0 and tokens[i - 1][1] == start and before in "@.-+_%(") or (
        j + 1 < len(tokens) and tokens[j + 1][0] == end and text[end] in "@-_(" 
    )
    found = ["any", f"shape={shape[:24]}", f"digits={min(len(digits), 20)}", f"groups={min(len(groups), 6)}"]
    found += [f"tokens={min(j - i, 8)}", f"touches={touches}", f"open={span[0]}" if not span[0].isalnum() else "open=w"]
    found.append(f"close={span[-1]}" if not span[-1].isalnum() else "close=w")
    if re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]+[A-Za-z0-9-]*", flat):
        found.append("mailbox")
    elif re.search(r"[A-Za-z]", flat):
        found.append("letters")
    octets = re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", flat) is not None and all(int(g) <= 255 for g in groups)
    found.append(f"octets={octets}")
    if 16 <= len(digits) <= 19 and not re.search(r"[A-Za-z@+]", span):
        found.append(f"luhn={luhn(digits)}")
    if 8 <= len(digits) <= 15 and not re.search(r"[A-Za-z@]", span):
        found.append("dialled")
        found.append("dialled=" + "-".join(str(len(g)) for g in groups))
    if before.isalpha() and before in ("tel", "phone", "call", "mobile", "card", "ip", "mail", "email"):
        found.append(f"before={before}")
    return found


class Field:
    """Weights of a semi-Markov field, and what is needed to score and decode with them."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}

    def segments(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
        tokens = [m.span() for m in TOKEN.finditer(text)]
        found = []
        for i in range(len(tokens)):
            for j in range(i, min(len(tokens), i + LONGEST)):
                features = segment_features(text, tokens, i, j)
                if features is not None:
                    found.append((i, j, features))
        return tokens, found

    def score(self, features: list[str]) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                total += w
        return total

    def decode(self, text: str) -> list[Span]:
        """The best labelling; a token outside spans scores nothing."""
        tokens, segments = self.segments(text)
        best = np.zeros(len(tokens) + 1)
        back: list[tuple[int, int] | None] = [None] * (len(tokens) + 1)
        by_end: dict[int, list] = {}
        for i, j, features in segments:
            scores = self.score(features)
            k = int(scores.argmax())
            if scores[k] > 0:
                by_end.setdefault(j, []).append((i, k, scores[k]))
        for j in range(len(tokens)):
            best[j + 1] = best[j]
            for i, k, s in by_end.get(j, ()):
                if best[i] + s > best[j + 1]:
                    best[j + 1], back[j + 1] = best[i] + s, (i, k)
        spans, at = [], len(tokens)
        while at:
            if back[at] is None:
                at -= 1
            else:
                i, k = back[at]
                spans.append((KINDS[k], tokens[i][0], tokens[at - 1][1]))
                at = i
        return spans[::-1]

    def fit(self, examples: list[tuple[str, list[Span]]], epochs: int = 6, rate: float = 0.5, decay: float = 1e-4) -> Field:
        """Maximise the conditional likelihood: gold features less expected ones, in fixed order."""
        prepared = []
        for text, spans in examples:
            tokens, segments = self.segments(text)
            gold = {(s, e): KINDS.index(kind) for kind, s, e in spans}
            truth = [gold.get((tokens[i][0], tokens[j][1])) for i, j, _ in segments]
            if sum(t is not None for t in truth) == len(gold):
                prepared.append((len(tokens), segments, truth))
        squares: dict[str, np.ndarray] = {}
        for _ in range(epochs):
            for n, segments, truth in prepared:
                if not segments:
                    continue
                scores = np.array([self.score(f) for _, _, f in segments])
                expected = marginals(n, segments, scores)
                for (_, _, features), t, p in zip(segments, truth, expected):
                    step = -p
                    if t is not None:
                        step = step.copy()
                        step[t] += 1
                    if abs(step).max() < 1e-3:
                        continue
                    for f in features:
                        w = self.weights.setdefault(f, np.zeros(len(KINDS)))
                        q = squares.setdefault(f, np.full(len(KINDS), 1e-2))
                        g = step - decay * w
                        q += g * g
                        w += rate * g / np.sqrt(q)
        return self


def marginals(n: int, segments: list, scores: np.ndarray) -> np.ndarray:
    """Probability of each segment and kind, by sums forward and backward over labellings."""
    top = scores.max(axis=1)
    either = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
    ending, starting = [[] for _ in range(n)], [[] for _ in range(n)]
    for s, (i, j, _) in enumerate(segments):
        ending[j].append((i, either[s]))
        starting[i].append((j, either[s]))

    def add(values: list[float]) -> float:
        most = max(values)
        return most + math.log(sum(math.exp(v - most) for v in values))

    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(n):
        ahead[j + 1] = add([ahead[j], *(ahead[i] + s for i, s in ending[j])])
    for i in range(n - 1, -1, -1):
        behind[i] = add([behind[i + 1], *(behind[j + 1] + s for j, s in starting[i])])
    outside = np.array([ahead[i] + behind[j + 1] for i, j, _ in segments]) - ahead[n]
    return np.exp(scores + outside[:, None])


def rewritten(text: str, span: Span) -> list[tuple[str, list[Span]]]:
    """The passage with the span in other notations, and where it then is."""
    kind, s, e = span
    old = text[s:e]
    forms = {
        "email": [old.replace("@", " [at] ").replace(".", " [dot] "), old.replace("@", "(at)")],
        "ip": [old.replace(".", "[.]")],
        "card": [".".join(re.sub(r"[^0-9]", "", old)[i : i + 4] for i in range(0, 20, 4)).strip(".")],
        "phone": [re.sub(r"^\+[0-9]+[\x20-]", "", old)],
    }[kind]
    return [(text[:s] + f + text[e:], [(kind, s, s + len(f))]) for f in forms if f != old and sum(c.isdigit() for c in f) != 7]


def example(text: str, span: Span | None) -> list[tuple[str, list[Span]]]:
    return [(text, [])] if span is None else [(text, [span]), *rewritten(text, span)]


def plain_numbers(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Passages with dates, prices, versions and other numbers that are nobody's data."""
    import random

    draw = random.Random(seed)

    def digits(k: int) -> str:
        return "".join(draw.choice("0123456789") for _ in range(k))

    forms = (
        lambda: f"on {digits(2)}/{digits(2)}/{digits(4)} we",
        lambda: f"since {digits(4)}-{digits(2)}-{digits(2)} at {digits(2)}:{digits(2)} it",
        lambda: f"paid {digits(2)}.{digits(2)} for {digits(3)} of",
        lambda: f"version {digits(1)}.{digits(1)}.{digits(2)} and {digits(1)}.{digits(1)}",
        lambda: f"the {digits(1)},{digits(3)},{digits(3)} items in {digits(4)} (of {digits(2)})",
        lambda: f"no {digits(5)} {digits(8)} {digits(10)} or",
        lambda: f"pages {digits(3)}-{digits(3)}, see {digits(2)}.",
        lambda: f"user{digits(3)} @ {digits(2)} and @name{digits(1)}",
    )
    return [(forms[i % len(forms)](), []) for i in range(n)]


def samples(text: str) -> list[tuple[str, Span | None]]:
    """Passages of a text for training: each exact span that stands apart, and what else has triggers.

    Of a passage without a span the first `PLAIN` characters are an example; nothing else is cut.
    """
    spans = exact_spans(text)
    found = []
    for n, (kind, s, e) in enumerate(spans):
        low, high = max(0, s - CONTEXT), min(len(text), e + CONTEXT)
        if not any(m != n and x[1] < high and x[2] > low for m, x in enumerate(spans)):
            found.append((text[low:high], (kind, s - low, e - low)))
    found += [(text[low : min(high, low + PLAIN)], None) for low, high in passages(text, spans)]
    return found


def train(docs: DataFrame, text: str = "text", sample: int = 150, seed: int = 5) -> Field:
    """Fit a field on at most `sample` different passages of each kind, and `sample` without a span.

    They are the first in the order of a seeded hash, so the choice does not depend on the
    partitioning. Passages are a few words long and written once; the driver gets the sample only.
    """
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *(s or ("", 0, 0))) for t in batch.column(0) if t.is_valid for p, s in samples(t.as_py())]
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list("pkse"))

    found = docs.select(F.col(text).alias("t")).mapInArrow(gather, "p string, k string, s int, e int")
    found = written(found.distinct().withColumn("h", F.xxhash64(F.lit(seed), "p", "s")), "passages")
    examples = plain_numbers(sample, seed)
    for kind in (*KINDS, ""):
        rows = found.filter(F.col("k") == kind).orderBy("h", "p", "s").limit(sample).collect()
        for row in rows:
            examples += example(row["p"], (kind, row["s"], row["e"]) if kind else None)
    return Field().fit(examples)


def spell(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Exact spans, and those with the field's; both by kind, then place."""
    exact = exact_spans(text)
    added = []
    for low, high in passages(text, exact):
        added += [(kind, low + s, low + e) for kind, s, e in field.decode(text[low:high])]
    return exact, sorted(exact + added, key=lambda x: (KINDS.index(x[0]), x[1]))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", field: Field | None = None, **kwargs) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_added, spans) for every document.

    Counts and digest are of the exact spans; `spans` has all, as kind:start:end in code points.
    The field adds spans beside the exact ones, which always stay. Without a given field one is
    trained on these documents.

    Texts are read whole. Patterns work in linear time, and the field only sees the passages
    around digits and at signs that no exact span covers; spans have at most LONGEST tokens. Null
    and empty texts have no spans. Without any exact span there is nothing to learn and nothing
    is added. Equal rows give equal results; null ids are passed on; other columns are not read.
    """
    field = field or train(docs, text, **kwargs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                exact, everything = find_spans(t.as_py() or "", field)
                counts = [sum(k == kind for k, _, _ in exact) for kind in KINDS]
                digest = hashlib.sha256(spell(exact).encode()).hexdigest()
                rows.append((*counts, digest, len(everything) - len(exact), spell(everything)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "n_added", "spans"]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    kinds = [id_type, *["bigint"] * 4, "string", "bigint", "string"]
    return rows.mapInArrow(find, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
