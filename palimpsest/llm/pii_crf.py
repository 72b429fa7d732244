"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field labels words O, or B/I of email, ip, card, phone. Its features are a word's shape, coarser forms of it, and
the shapes of and hints in the words around. It is trained here from a small labelled table that is made from
templates (labelled_table), by exact gradients of the likelihood. A word without a digit, "@" or "at" mark can only be
O, which makes the chain fall apart there: Viterbi over each run of other words, many runs at a time in numpy, finds
the best labels of the whole text. Spans it finds are added if they pass their kind's check and don't touch a base one.

Base patterns are matched leftmost and without overlap for each kind, in time linear in the text: an email from its
"@" to both sides, the rest with possessive patterns that give the same matches as the plain ones.

Cases: null and empty texts have no spans. Offsets are code points, ends exclusive. Very long texts are matched whole.
Repeated rows give the same spans; null doc_ids and other columns are kept as they are.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, trimmed
from .token_files import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
SPACE = " \t\n\x0b\x0c\r"

# --- base patterns ---------------------------------------------------------------------------------------------
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGN = re.compile(r"[0-9@]|[(\[]at[)\]]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), kinds by their place in KINDS."""
    out = [(a, 0, z) for a, z in emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the labelled table ----------------------------------------------------------------------------------------
TEMPLATES = (
    "write to {email} for more", "mail {email}", "my address is {email} , thanks", "contact {email} or {phone} today", "e-mail: {email}",
    "call {phone} now", "phone {phone}", "tel: {phone}", "reach us at {phone} .", "fax {phone} or mail {email}", "mobile {phone} after noon", "dial {phone}",
    "card {card} was charged", "visa {card}", "pay with {card} please", "credit card number {card} expires {date}",
    "server {ip} is down", "ping {ip}", "the host {ip} and {ip} answered", "from ip {ip} at {time}",
    "on {date} we met", "in {year} there were {number} of them", "order {order} was sent", "version {version} of it", "costs {price} each", "the key {hex} is secret",
    "at {time} on {date}", "page {number} of {number}", "row {number} {number} {number} {number}", "see section {section}", "isbn {isbn}", "born {date} in {year}", "commit {hex}",
    "score {number} to {number} in {year}", "{number} and {price}", "id {order} dated {date}", "lat {coord} lon {coord}", "token {key}", "room {number} , floor {number}",
)


def labelled_table(copies: int = 24, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Words and labels of sentences made from TEMPLATES."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 8)))

    def card() -> str:
        d = digits(r.choice((15, 15, 14, 13)))
        d = next(d + c for c in string.digits if luhn(d + c))
        return r.choice((d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), ".".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))))

    make = {
        "email": lambda: r.choice(("{}@{}.com", "{}.x@{}.org", "{}(at){}.com", "{}[at]{}.net", "{}_1@mail.{}.de", "{}9@{}.example.com")).format(word(), word()),
        "phone": lambda: r.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}-{}", "+1 ({}) {}-{}", "+1-{}-{}-{}", "{} {} {}")).format(digits(3), digits(3), digits(4)),
        "card": card, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "date": lambda: r.choice(("{2}-{0:02}-{1:02}", "{0:02}/{1:02}/{2}", "{1:02}.{0:02}.{2}")).format(r.randint(1, 12), r.randint(1, 28), r.randint(1950, 2030)),
        "year": lambda: str(r.randint(1900, 2035)), "number": lambda: r.choice((digits(1), digits(2), digits(3), digits(4), digits(5), digits(6), digits(8), "1," + digits(3), digits(2) + "%")),
        "order": lambda: r.choice(("#" + digits(6), "A" + digits(7), digits(4) + "-" + digits(5), digits(10), digits(12))), "version": lambda: r.choice(("{}.{}.{}", "v{}.{}", "{}.{}", "{}.{}.{}-rc1")).format(r.randint(0, 20), r.randint(0, 40), r.randint(0, 90)),
        "price": lambda: r.choice(("${}.{}", "{}.{}")).format(digits(2), digits(2)), "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 32, 40)))),
        "time": lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}", "section": lambda: f"{r.randint(1, 9)}.{r.randint(1, 30)}.{r.randint(1, 30)}", "isbn": lambda: "978-" + digits(1) + "-" + digits(4) + "-" + digits(4) + "-" + digits(1),
        "coord": lambda: f"{digits(2)}.{digits(6)}", "key": lambda: "AKIA" + "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(16)),
    }
    out = []
    for _ in range(copies):
        for t in TEMPLATES:
            words, labels = [], []
            for part in t.split():
                if m := re.fullmatch(r"\{(\w+)\}", part):
                    found = make[m[1]]().split()
                    if r.random() < 0.25:
                        found[-1] += r.choice(".,;")
                    words += found
                    labels += [f"{'I' if k else 'B'}-{m[1]}" if m[1] in KINDS else "O" for k in range(len(found))]
                else:
                    words.append(part if r.random() < 0.5 else word())
                    labels.append("O")
            out.append((words, labels))
    return out


# --- features --------------------------------------------------------------------------------------------------
HINTS = {"call": "phone", "phone": "phone", "tel": "phone", "fax": "phone", "mobile": "phone", "dial": "phone", "card": "card", "visa": "card", "credit": "card", "pay": "card", "ip": "ip", "server": "ip", "host": "ip", "ping": "ip", "mail": "email", "e-mail": "email", "email": "email", "contact": "email"}
RUNS = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|[^\W\d_]+|(.)\1*", re.S)


def shape(word: str) -> str:
    """Runs of digits with their length, of letters without, and signs: "(771)" is "(3)", "a.b@c.com" is "a.a@a.a"."""
    out = []
    for m in RUNS.finditer(word):
        x = m[0]
        out.append(str(min(len(x), 20)) if x.isascii() and x.isdigit() else "a" if x[0].isalpha() else x[0])
    return "".join(out)


def word_features(word: str) -> tuple[str, ...]:
    core = word.strip(".,;:!?\"'")
    s, n = shape(core), sum(map(str.isdigit, word))
    return f"s={s}", f"c={re.sub('[0-9]+', 'd', s)[:12]}", f"n={min(n, 20)}", f"@={'@' in word}", f"at={bool(re.search(r'[(\[]at[)\]]', word))}", f"dots={min(word.count('.'), 5)}", f"alpha={any(map(str.isalpha, word))}", f"first={core[:1] if core[:1] in '+($#' else ''}"


def around(word: str, where: str) -> tuple[str, ...]:
    return f"{where}s={shape(word.strip('.,;:!?'))}" if any(map(str.isdigit, word)) else f"{where}a", f"{where}h={HINTS.get(word.lower().strip('.,;:!?'), '')}"


#: No feature tells one digit from another, so what is known of a word is kept for all words of like digits.
ONE_DIGIT = str.maketrans("123456789", "000000000")
#: Words of which a field keeps scores, and steps of runs that it works on together.
MEMO, STEPS = 50_000, 1 << 16


def can_be(word: str) -> bool:
    return bool(SIGN.search(word))


class Field:
    """The trained field: weights of features and of steps from label to label."""

    def __init__(self, seed: int = 5, rounds: int = 120, ridge: float = 0.02):
        runs, labels = [], []
        for words, ls in labelled_table():
            padded, k = ["", "", *words, "", ""], 0
            while k < len(words):
                if not can_be(words[k]):
                    k += 1
                    continue
                j = k
                while j < len(words) and can_be(words[j]):
                    j += 1
                runs.append((padded[k + 1], words[k:j], padded[j + 2]))
                labels.append([LABELS.index(x) for x in ls[k:j]])
                k = j
        self.index: dict[str, int] = {}
        rows = [[[self.index.setdefault(f, len(self.index)) for f in fs] for fs in self.features(r)] for r in runs]
        n, steps, width = len(runs), max(map(len, labels)), max(len(x) for r in rows for x in r)
        self.empty = len(self.index)
        ids, gold, inside = np.full((n, steps, width), self.empty), np.zeros((n, steps), np.int64), np.zeros((n, steps), bool)
        for i, (r, ls) in enumerate(zip(rows, labels)):
            for t, (fs, y) in enumerate(zip(r, ls)):
                ids[i, t, : len(fs)], gold[i, t], inside[i, t] = fs, y, True
        k = len(LABELS)
        allowed = np.array([[not b.startswith("I") or a[2:] == b[2:] and a != "O" for b in LABELS] for a in LABELS])
        self.barred, self.start = np.where(allowed, 0.0, -1e4), np.array([-1e4 if x.startswith("I") else 0.0 for x in LABELS])
        self.weights, self.step, self.known = np.zeros((self.empty + 1, k)), np.zeros((k, k)), {}
        moments = [np.zeros_like(x) for x in (self.weights, self.weights, self.step, self.step)]
        for epoch in range(1, rounds + 1):
            gw, gs = self._gradient(ids, gold, inside)
            for x, g, m, v in ((self.weights, gw, *moments[:2]), (self.step, gs, *moments[2:])):
                g = g / n - ridge / 10 * x
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += 0.2 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
            self.weights[self.empty] = 0

    def _gradient(self, ids, gold, inside):
        """Observed less expected counts, by forward and backward sums in logarithms."""
        n, steps, _ = ids.shape
        e, trans = self.weights[ids].sum(2), self.step + self.barred
        total = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        fore, back = np.zeros_like(e), np.zeros_like(e)
        fore[:, 0] = e[:, 0] + self.start
        for t in range(1, steps):
            fore[:, t] = np.where(inside[:, t, None], total(fore[:, t - 1][:, :, None] + trans, 1) + e[:, t], fore[:, t - 1])
        for t in range(steps - 2, -1, -1):
            back[:, t] = np.where(inside[:, t + 1, None], total(trans + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0.0)
        whole = total(fore[:, -1], 1)
        p = np.exp(fore + back - whole[:, None, None]) * inside[:, :, None]
        delta = -p
        i, t = np.nonzero(inside)
        delta[i, t, gold[i, t]] += 1
        gw, gs = np.zeros_like(self.weights), np.zeros_like(self.step)
        np.add.at(gw, ids.reshape(n * steps, -1), delta.reshape(n * steps, 1, -1))
        for t in range(1, steps):
            at = inside[:, t]
            if at.any():
                both = np.exp(fore[at, t - 1][:, :, None] + trans + (e[at, t] + back[at, t])[:, None, :] - whole[at, None, None])
                gs -= both.sum(0)
                np.add.at(gs, (gold[at, t - 1], gold[at, t]), 1)
        return gw, gs

    def features(self, run: tuple[str, list[str], str]) -> list[list[str]]:
        before, words, after = run
        padded = [before, *words, after]
        return [[*word_features(w), *around(padded[k], "-"), *around(padded[k + 2], "+")] for k, w in enumerate(words)]

    def scores(self, words: list[str]) -> np.ndarray:
        """Of each word, the labels' scores by its own features, and what it adds to the word after and to the one before."""
        if len(self.known) > MEMO:
            self.known = {}
        out = []
        for w in words:
            key = w.translate(ONE_DIGIT)
            if (x := self.known.get(key)) is None:
                x = np.array([self.weights[[self.index.get(f, self.empty) for f in fs]].sum(0) for fs in (word_features(key), around(key, "-"), around(key, "+"))])
                if len(key) <= 64:
                    self.known[key] = x
            out.append(x)
        return np.array(out)

    def decode(self, runs: list[tuple[str, list[str], str]]) -> list[np.ndarray]:
        """Viterbi labels of each run; runs of like length are worked on together."""
        out: list = [None] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i][1]))
        trans, at = self.step + self.barred, 0
        while at < len(order):
            longest, stop = len(runs[order[at]][1]), at
            while stop < len(order) and (n := len(runs[order[stop]][1])) <= max(8, 2 * longest) and (stop == at or (stop - at + 1) * n <= STEPS):
                stop += 1
            group = order[at:stop]
            steps = len(runs[group[-1]][1])
            e = np.zeros((len(group), steps, len(LABELS)))
            sizes = np.array([len(runs[i][1]) for i in group])
            for g, i in enumerate(group):
                before, words, after = runs[i]
                x = self.scores([before, *words, after])
                e[g, : len(words)] = x[1:-1, 0] + x[:-2, 1] + x[2:, 2]
            score, back = e[:, 0] + self.start, np.zeros((len(group), steps, len(LABELS)), np.int8)
            for t in range(1, steps):
                way = score[:, :, None] + trans
                back[:, t] = way.argmax(1)
                score = np.where((t < sizes)[:, None], way.max(1) + e[:, t], score)
            best = score.argmax(1)
            labels = np.zeros((len(group), steps), np.int64)
            for t in range(steps - 1, -1, -1):
                labels[:, t] = best
                best = np.where((t < sizes) & (t > 0), back[np.arange(len(group)), t, best], best)
            for g, i in enumerate(group):
                out[i] = labels[g, : sizes[g]]
            at = stop
        return out


FIELDS: list[Field] = []


def field() -> Field:
    """One for each process; training takes a few seconds and always gives the same weights."""
    if not FIELDS:
        FIELDS.append(Field())
    return FIELDS[0]


# --- texts -----------------------------------------------------------------------------------------------------
MAY_BE = re.compile(r"(?<![^\x20\x09-\x0D])(?:(?![(\[]at[)\]])[^\x20\x09-\x0D0-9@])*+(?:[0-9@]|[(\[]at[)\]])[^\x20\x09-\x0D]*+")
BEFORE = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*\Z")
AFTER = re.compile(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)")


def runs_of(text: str) -> list[tuple[str, list[str], str, list[int]]]:
    """Runs of words that may be other than O, with the words around and their starts."""
    out: list = []
    end = -1
    for m in MAY_BE.finditer(text):
        if out and text[end : m.start()].isspace():
            out[-1][1].append(m[0])
            out[-1][3].append(m.start())
        else:
            back, first = 80, max(end, 0)
            while True:  # until the word before is in sight, with its beginning
                b = BEFORE.search(text, max(first, m.start() - back), m.start()) if m.start() else None
                if m.start() - back <= first or b and b.start() > m.start() - back:
                    break
                back *= 4
            out.append([b[0].strip(SPACE) if b else "", [m[0]], "", [m.start()]])
        end = m.end()
        a = AFTER.match(text, end)
        out[-1][2] = a[1] if a else ""
    return out


def fits(kind: int, span: str) -> bool:
    """Whether what the field found can be of its kind at all."""
    digits = NOT_DIGIT.sub("", span)
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@()\[\]]+(?:@|\(at\)|\[at\])[A-Za-z0-9-]+(?:(?:\.|\(dot\)|\[dot\])[A-Za-z0-9-]+)+", span))
    if kind == 1:
        parts = span.split(".")
        return len(parts) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and not any(map(str.isalpha, span))
    return 10 <= len(digits) <= 15 and not any(map(str.isalpha, span)) and bool(re.search(r"[0-9][\x20().-]+[0-9]", span))


def spans_of(texts: list[str], own: Field) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    base = [base_spans(x) if SIGN.search(x) else [] for x in texts]
    runs = [(i, r) for i, x in enumerate(texts) if SIGN.search(x) for r in runs_of(x)]
    added: list[list] = [[] for _ in texts]
    for (i, (_, words, _, starts)), labels in zip(runs, own.decode([(b, w, a) for _, (b, w, a, _) in runs])):
        k = 0
        while k < len(labels):
            if labels[k] % 2 != 1:  # B-: odd
                k += 1
                continue
            kind, j = (int(labels[k]) - 1) // 2, k + 1
            while j < len(labels) and labels[j] == labels[k] + 1:
                j += 1
            a, z = starts[k], starts[j - 1] + len(words[j - 1])
            while a < z and texts[i][a] in "\"'<[,;:" + "(" * (kind != 3):
                a += 1
            while a < z and texts[i][z - 1] in ".,;:!?)>]\"'":
                z -= 1
            if fits(kind, texts[i][a:z]) and not any(s < z and a < e for s, _, e in base[i]):
                added[i].append((a, kind, z))
            k = j
    return [(b, sorted([*b, *a])) for b, a in zip(base, added)]


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (array of kind, start, end) of each row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(field())
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            got = [s for x in slices(texts) for s in spans_of(texts[x], sent.value)]
            as_rows = lambda s: [{"kind": KINDS[k], "start": a, "end": z} for a, k, z in s]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_rows(b) for b, _ in got], span), pa.array([as_rows(s) for _, s in got], span)], ["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, f"doc_id long, base {kind}, spans {kind}")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in angle brackets; n_chars, if there, follows."""
    sent, names, schema = docs.sparkSession.sparkContext.broadcast(field()), docs.columns, docs.schema
    at = names.index("text")

    def masked(text: str, spans: list) -> str:
        out, end = [], 0
        for a, k, z in spans:
            if a >= end:
                out += [text[end:a], f"<{KINDS[k].upper()}>"]
            end = max(end, z)
        return "".join([*out, text[end:]])

    def work(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            plain = [x or "" for x in texts]
            got = [s for x in slices(plain) for s in spans_of(plain[x], sent.value)]
            new = [None if x is None else masked(x, s) if s else x for x, (_, s) in zip(texts, got)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)
        trimmed()

    out = docs.mapInArrow(work, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found(table(spark, sf_dir, "documents")).select("doc_id", *map(n, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
