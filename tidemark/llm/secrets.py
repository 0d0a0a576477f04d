"""Secret scans: candidates by pattern, and a random forest over their features that removes false positives."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bounded_batches

#: Labelled findings that the default forest learns from.
FINDINGS = 2400
#: Characters of the text on either side that a finding's neighbouring words are taken from.
AROUND = 48
#: What begins so many characters into an assigned value is a candidate of its own as well.
HEAD = 200
#: Characters of a candidate that features are taken from, its length apart.
LOOK = 1024
MASK = "[SECRET]"
# Names that secrets go by, and words of examples.
NAMES = ("token", "secret", "password", "passwd", "apikey", "api_key", "access_key", "auth", "credential", "bearer", "private_key")
SAMPLES = ("example", "test", "sample", "dummy", "placeholder", "changeme", "your", "xxxx", "docs", "spec", "mock", "fixture")
_ASSIGNED = re.compile(r"(?:token|secret|passw(?:or)?d|api_?key|access_?key|auth|credential|private_?key)[\w.-]{0,20}[\"']?[ \t]{0,4}(?:=>|:=|=|:)[ \t]{0,4}[\"']?([^\s\"'<>|]{8})", re.I)
_VALUE_END = re.compile(r"[\s\"'<>|]|\Z")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}")
_HINT = re.compile("token|secret|passw|key|auth|cred", re.I)
_WORD = re.compile(r"\w+")
FEATURES = ("length", "entropy", "transitions", "digits", "capitals", "kinds", "hex", "coverage", "repeats", "assigned", "quoted", "named_left", "known_left", "known_right", "sample_near", "sample_path", "sample_inside")


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, assigned), leftmost first, each the whole run whatever its length; a long run in the first HEAD characters of an assigned value is not a candidate of its own."""
    found, out, at, end = {}, [], 0, 0
    if _HINT.search(text):
        while m := _ASSIGNED.search(text, at):
            if m.end() > end:
                end = _VALUE_END.search(text, m.end()).start()
            found[m.start(1)] = (m.start(1), end, True)
            at = min(end, m.start(1) + HEAD)
            out.append((m.start(1), at))
    # both go from left to right, and heads don't overlap
    k = 0
    for m in _LONG.finditer(text):
        while k < len(out) and out[k][1] <= m.start():
            k += 1
        if k == len(out) or out[k][0] >= m.end():
            found[m.start()] = (m.start(), m.end(), False)
    return sorted(found.values())


class Language:
    """What ordinary text looks like: how letters follow one another, and its words; learned from findings labelled as none and from neighbouring words."""

    def __init__(self, texts: list[str]):
        pairs, words = Counter(), Counter()
        for t in texts:
            low = t.lower()
            pairs.update(zip(low, low[1:]))
            words.update(w for w in re.findall(r"[^\W\d_]{3,}", low))
        first = Counter()
        for (a, _), n in pairs.items():
            first[a] += n
        self.first, self.pairs = dict(first), dict(pairs)
        self.words = {w for w, _ in words.most_common(20_000)}

    def transitions(self, s: str) -> float:
        """Mean log probability of each character after the one before it."""
        low = s.lower()
        return sum(math.log((self.pairs.get((a, b), 0) + 0.2) / (self.first.get(a, 0) + 12)) for a, b in zip(low, low[1:])) / max(1, len(s) - 1)

    def coverage(self, s: str) -> float:
        """Share of the characters that lie in words of the dictionary, longest first."""
        low, i, n = s.lower(), 0, 0
        while i < len(low):
            for k in range(min(12, len(low) - i), 2, -1):
                if low[i : i + k] in self.words:
                    n += k
                    i += k
                    break
            else:
                i += 1
        return n / max(1, len(s))


def features(language: Language, s: str, left: str, right: str, path: str, assigned: bool) -> list[float]:
    length, s = len(s), s[:LOOK]
    n = max(1, len(s))
    counts = Counter(s)
    before, after = _WORD.findall(left.lower())[-4:], _WORD.findall(right.lower())[:4]
    share = lambda test: sum(map(test, s)) / n
    known = lambda ws: sum(w in language.words for w in ws) / max(1, len(ws))
    near = " ".join(before + after)
    return [
        float(length), -sum(c / n * math.log2(c / n) for c in counts.values()), language.transitions(s), share(str.isdigit), share(str.isupper),
        float(sum(any(map(t, s)) for t in (str.isdigit, str.isupper, str.islower, lambda c: not c.isalnum()))), float(bool(re.fullmatch("[0-9a-fA-F]+", s))), language.coverage(s),
        sum(a == b for a, b in zip(s, s[1:])) / n, float(assigned), float(left[-1:] in "\"'" and left != ""), float(any(k in w for w in before for k in NAMES)), known(before), known(after),
        float(any(k in near for k in SAMPLES)), float(any(k in (path or "").lower() for k in SAMPLES)), float(any(k in s.lower() for k in SAMPLES)),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 23) -> list[tuple[str, str, str, str, bool, int]]:
    """(candidate, left, right, path, assigned, label): what to learn from where no labelled findings are given. Invented keys among invented words, and the usual false findings."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[r.integers(len(xs))]
    of = lambda chars, k: "".join(pick(chars) for _ in range(k))
    syllables = ["the", "tion", "and", "ing", "er", "on", "an", "re", "st", "en", "le", "que", "de", "la", "mente", "ung", "ver", "be", "ou", "ent", "as", "ar", "ado", "ie", "lich", "her", "in", "at", "es", "or", "al", "os"]
    word = lambda: "".join(pick(syllables) for _ in range(r.integers(1, 5)))
    words = lambda k: " ".join(word() for _ in range(k))
    low, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    full = low + low.upper() + digit
    out = []
    for i in range(n):
        left, right, path = words(4) + " ", " " + words(4), pick([f"src{r.integers(40)}", f"src/{word()}.py", f"conf/{word()}.yml"])
        if i % 2:
            s = pick([of(hexa, 40), of(hexa, 40).upper(), of(hexa, 32), of(full, r.integers(20, 64)), "AKIA" + of(low.upper() + digit, 16), "ghp_" + of(full, 36), of(full + "+/", 43) + "=", of(full + "!#$%", r.integers(10, 20))])
            if r.random() < 0.85:
                name, quote = pick(NAMES), pick(['"', '"', "'", ""])
                sign = pick([" = ", " = ", "=", ": "])
                left, right, assigned = f"{left}{name.upper() if r.random() < 0.2 else name}{sign}{quote}", quote + right, True
            else:
                assigned = False
            out.append((s, left, right, path, assigned, 1))
            continue
        u = r.integers(7)
        assigned = u < 3
        if u == 0:
            s = pick(["your_" + pick(NAMES) + "_here", "changeme123", "xxxxxxxxxxxxxxxx", "example-" + word(), "placeholder", "<" + word() + ">", "dummy_token_1", "test" + of(digit, 4)])
        elif u == 1:
            s = pick([word() + "_" + word(), word() + "." + word() + "()", "get_" + word() + "_" + word(), word() + word(), "${" + word().upper() + "}"])
        elif u == 2:
            s, path = of(hexa, 40), pick(["tests/fixtures/a.json", "docs/example.md", "spec/mock.rb"])
            left += "example " if r.random() < 0.5 else "test "
        elif u == 3:
            s = "-".join([of(hexa, 8), of(hexa, 4), of(hexa, 4), of(hexa, 4), of(hexa, 12)])
        elif u == 4:
            s = pick([of(digit, 20), of(digit, 4) + "-" + of(digit, 2) + "-" + word() + "-" + word() + of(digit, 2), word() + "-" + word() + "-" + word() + of(digit, 3)])
        elif u == 5:
            s = "/".join(word() for _ in range(5)) + of(digit, 2)
        else:
            s, left = of(hexa, 40), left + pick(["commit ", "sha1 ", "checksum ", "revision "])
        if assigned:
            left += pick(NAMES) + pick([" = ", ": "]) + pick(['"', ""])
        out.append((s, left[-AROUND:], right[:AROUND], path, assigned, 0))
    return out


class Scorer:
    """A fitted forest as arrays, to score rows within a map task as Spark does: the mean over the trees of the share of secrets in a row's leaf."""

    def __init__(self, forest):
        self.nodes: list[tuple[int, float, int, int, float]] = []  # feature (-1: a leaf), threshold, left, right, share
        self.roots = [self._add(tree.rootNode()) for tree in forest._java_obj.trees()]
        self.feature, self.threshold, self.left, self.right, self.share = (np.array(x) for x in zip(*self.nodes))

    def _add(self, node) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, at, at, 0.0))
        if node.subtreeDepth() == 0:
            none, secret = node.impurityStats().stats()
            self.nodes[at] = -1, 0.0, at, at, secret / (none + secret)
        else:
            split = node.split()
            self.nodes[at] = split.featureIndex(), split.threshold(), self._add(node.leftChild()), self._add(node.rightChild()), 0.0
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rows, at = np.arange(len(x))[:, None], np.tile(self.roots, (len(x), 1))
        while (self.feature[at] >= 0).any():
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.share[at].sum(1) / len(self.roots)


_FOREST: dict[tuple, tuple] = {}


def fit_forest(spark: SparkSession, findings=None, trees: int = 24, depth: int = 7):
    """(forest, language) from labelled findings; the default findings are learned from once in a session."""
    key = (spark.sparkContext.applicationId, trees, depth)
    if findings is None and key in _FOREST:
        return _FOREST[key]
    rows = labelled_findings() if findings is None else findings
    language = Language([f"{f[1]} {f[2]}" for f in rows] + [f[0] for f in rows if not f[5]])
    data = spark.createDataFrame([(float(f[5]), features(language, f[0], f[1], f[2], f[3], f[4])) for f in rows], "label double, x array<double>").coalesce(1)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=17, featureSubsetStrategy="sqrt").fit(data.select("label", array_to_vector("x").alias("features")))
    # the summary of the training holds the session, which tasks cannot take once anything was observed in it
    forest._java_obj.setSummary(spark._jvm.scala.Option.empty())
    if findings is None:
        _FOREST[key] = forest, language
    return forest, language


def scan_secrets(docs: DataFrame, findings=None, threshold: float = 0.5) -> DataFrame:
    """-> doc_id, start, end, assigned, score, is_secret: a row for each candidate, in characters of the text; those under the threshold are false positives.

    Candidates are values that are assigned to a name of secrets, and long runs of letters and digits. The forest sees the candidate's length, character
    transitions, dictionary coverage and make-up, its path (source) and the words beside it. ``findings``: labelled findings as
    labelled_findings() gives them, the default. Null and clean texts give no rows; a null source is an empty path; a null doc_id and
    repeated rows are reported as they stand; other columns are ignored. Nothing is shuffled.
    """
    spark = docs.sparkSession
    forest, language = fit_forest(spark, findings)

    def run(batch):
        out = {"doc_id": [], "start": [], "end": [], "assigned": [], "x": []}
        for i, t, path in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("source").to_pylist()):
            for a, b, assigned in candidates(t) if t else ():
                out["doc_id"].append(i)
                out["start"].append(a)
                out["end"].append(b)
                out["assigned"].append(assigned)
                out["x"].append(features(language, t[a:b], t[max(0, a - AROUND) : a], t[b : b + AROUND], path, assigned))
        return out if out["x"] else None

    found = arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "cast(source as string) source"), run, "doc_id long, start int, end int, assigned boolean, x array<double>")
    scored = forest.transform(found.withColumn("features", array_to_vector("x")))
    return scored.select("doc_id", "start", "end", "assigned", vector_to_array("probability")[1].alias("score")).withColumn("is_secret", F.col("score") >= threshold)


def mask_secrets(docs: DataFrame, findings=None, threshold: float = 0.5, mask: str = MASK) -> DataFrame:
    """The documents, with each secret in their texts replaced by ``mask`` and n_chars counted anew where that was done; no document goes.

    Each row is scored and masked by itself, whatever its doc_id, in the task that reads it; nothing is shuffled. Secrets that overlap are masked as one.
    """
    forest, language = fit_forest(docs.sparkSession, findings)
    scorer = Scorer(forest)

    def masked(batch):
        texts, owner, spans, x = batch.column("text").to_pylist(), [], [], []
        for i, (t, path) in enumerate(zip(texts, batch.column("source").cast(pa.string()).to_pylist())):
            for a, b, assigned in candidates(t) if t else ():
                owner.append(i)
                spans.append((a, b))
                x.append(features(language, t[a:b], t[max(0, a - AROUND) : a], t[b : b + AROUND], path, assigned))
        secret: dict[int, list] = {}
        for k in np.flatnonzero(scorer(np.array(x)) >= threshold).tolist() if x else ():
            secret.setdefault(owner[k], []).append(spans[k])
        for i, found in secret.items():
            out, at = [], 0
            for a, b in sorted(found):
                if a >= at:
                    out += [texts[i][at:a], mask]
                at = max(at, b)
            texts[i] = "".join(out) + texts[i][at:]
        if secret:
            columns = {"text": texts}
            if "n_chars" in batch.schema.names:
                columns["n_chars"] = [len(texts[i]) if i in secret else n for i, n in enumerate(batch.column("n_chars").to_pylist())]
            for name, values in columns.items():
                k = batch.schema.names.index(name)
                batch = batch.set_column(k, batch.schema.field(k), pa.array(values, type=batch.schema.field(k).type))
        return batch

    def run(batches):
        for batch in batches:
            yield masked(batch)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
