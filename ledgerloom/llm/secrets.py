"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame functions only."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read, table

#: Plain documents that secrets are planted in for training, about, and planted findings of which the forest is trained at least if there is a document.
PLAIN_DOCS, PLANTED = 4_000, 4_000
#: Findings of each label that are used, at most.
TRAINING_FINDINGS = 4_000
#: The dictionary: words of so many letters that this share of all documents has at least. A share bounds its size at any corpus size.
DICTIONARY_SHARE, LEAST_LETTERS = 0.05, 3
TREES, DEPTH = 15, 6

_NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|api[_-]?key|access[_-]?key|auth)"
#: What stands before a value: an assignment to a name that secrets have, a user in a URL, a bearer's mark, the head of a private key.
_LEAD = rf"(?i:{_NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?|://[^\s:/@]{{1,64}}:|(?i:bearer)\s{{1,3}}|-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----"
#: A lead with its value (up to the closing quote, if it is quoted), or a run of 16 or more characters of the alphabets secrets are written in.
CANDIDATE = (
    rf"(?i:{_NAMES})[\"']?\s{{0,3}}[:=]\s{{0,3}}(?:\"[^\"\r\n]{{4,256}}|'[^'\r\n]{{4,256}}|[^\s\"'<>,;]{{4,}})"
    r"|://[^\s:/@]{1,64}:[^\s:/@]{3,}(?=@)|(?i:bearer)\s{1,3}[A-Za-z0-9._~+/=-]{12,}"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}|[A-Za-z0-9_+/=\-]{16,}"
)
_ASSIGNED = rf"(?:{_LEAD})$"
_ISSUED = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abpr]-[0-9A-Za-z-]{20,}|AIza[0-9A-Za-z_-]{35})"
_LIKELY = rf"{_LEAD}|{_ISSUED}"
_MARK = "\u0001"

FEATURES = ["size", "transitions", "digits", "upper", "variety", "hexadecimal", "longest_letters", "dictionary", "assigned", "quoted", "near_name", "near_placeholder", "path_depth", "path_test", "path_code", "path_bucket"]


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once for each row, however often it is used later: a generator holds it in place."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _candidates(rows: DataFrame) -> DataFrame:
    """Adds to rows with a text: head (the text before the first candidate) and candidates, an array in text order, null if there is none.

    One search marks the candidates, and the text is cut at the marks; a text that holds the mark itself is searched twice
    instead. The pieces between are the neighbouring text. A candidate holds the piece before and after it, what leads
    to its value, and its value.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.split(F.regexp_replace(text, CANDIDATE, f"{_MARK}$0{_MARK}"), _MARK, -1)
    hits, gaps = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    apart = F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda p: F.when(p["hit"].isNull(), F.array(p["gap"])).otherwise(F.array(p["gap"], p["hit"]))))
    rows = _once(rows, "parts", F.when(F.contains(text, F.lit(_MARK)), apart).otherwise(marked))
    every = lambda side: F.filter("parts", lambda _, i: i % 2 == side)
    zipped = F.arrays_zip(every(1).alias("hit"), every(0).alias("gap"), F.filter("parts", lambda _, i: (i > 0) & (i % 2 == 0)).alias("rest"))

    def describe(p: Column) -> Column:
        name = F.regexp_extract(p["hit"], f"^(?:{_LEAD})", 0)
        return F.struct(
            p["hit"].alias("hit"), name.alias("name"), F.substring(p["hit"], F.length(name) + 1, F.length(p["hit"])).alias("value"), p["rest"].alias("rest"), F.length(p["gap"]).alias("skip"),
            F.concat(F.substring(p["gap"], -40, 40), name).alias("before"), F.substring(p["rest"], 1, 24).alias("after"),
        )

    found = F.when(F.size("parts") > 1, F.transform(F.filter(zipped, lambda p: p["hit"].isNotNull()), describe))
    return _once(rows.withColumn("head", F.col("parts")[0]), "candidates", found).drop("parts")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, path and text with their candidates (null if there is none). No shuffle."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    return _candidates(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), F.col(text_col).alias("text")))


def features(c: Column, path: Column, dictionary: list[str]) -> list[Column]:
    """The forest's inputs for one candidate: shape of the value, dictionary coverage, neighbouring words, path."""
    value, before, after = c["value"], c["before"], c["after"]
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "l"), "[A-Z]+", "u"), "[0-9]+", "d"), "[^lud]+", "o")
    lower = F.lower(value)
    words = F.transform(F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), F.lower)
    covered = F.aggregate(F.filter(words, lambda w: w.isin(dictionary)), F.lit(0), lambda s, w: s + F.length(w)) if dictionary else F.lit(0)
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    d = lambda x: x.cast("double")
    return [
        size,
        (d(F.length(classes) - 1) / size),
        d(_share(value, "[^0-9]")),
        d(_share(value, "[^A-Z]")),
        (d(F.size(F.array_distinct(F.split(value, "")))) / F.least(size, F.lit(36.0))),
        d(value.rlike("^[0-9a-fA-F]+$")),
        d(F.coalesce(F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), F.length)), F.lit(0))),
        (d(covered) / size),
        d(before.rlike(_ASSIGNED)),
        d(before.rlike("[\"']$") & after.rlike("^[\"']")),
        d(before.rlike(rf"(?i)\b{_NAMES}\b")),
        d(F.concat(before, F.lit(" "), lower, F.lit(" "), after).rlike(r"(?i)example|sample|dummy|placeholder|changeme|xxxx|your[_-]")),
        d(F.size(F.split(path, "[/\\\\]"))),
        d(path.rlike(r"(?i)test|mock|fixture|example|docs?/")),
        d(path.rlike(r"(?i)\.(env|ini|cfg|conf|ya?ml|json|toml|py|js|java|go|sh)$")),
        d(F.pmod(F.xxhash64(path), F.lit(16))),
    ]


def planted(texts: DataFrame, seed: int = 1) -> DataFrame:
    """Labelled findings: the texts, each with a secret or a harmless look-alike planted at a place drawn by a hash; columns path, text, planted, label.

    Secrets are random values of issued formats, hexadecimal, base64, or passwords with signs, assigned to a name, in a URL, or
    behind a bearer's mark; issued formats also stand alone. Look-alikes are placeholders and plain words assigned to the same names, commit
    ids, digests, version-4 identifiers and bare numbers. So labels come from what was planted, not from a pattern.
    """
    texts = _once(texts, "h", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.sha2(F.concat_ws("/", F.lit(str(seed)), i.cast("string"), F.md5("text"), F.col("turn").cast("string")), 256)))
    h = lambda i: F.col("h")[i]
    draw = lambda i, n: (F.conv(F.substring(h(i), 1, 7), 16, 10).cast("int") % n)
    pick = lambda i, *values: F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), draw(i, len(values)) + 1)
    texts = _once(texts, "base64", F.regexp_replace(F.base64(F.unhex(h(1))), "=", ""))
    texts = _once(texts, "letters", F.regexp_replace("base64", "[+/]", "x"))
    password = F.concat(F.substring("base64", 1, 5), pick(2, "!", "@", "#", "$", "%", "&"), F.substring("base64", 6, 4), pick(3, "?", "*", "^", "7"))
    texts = _once(texts, "issued", pick(8, F.concat(F.lit("AKIA"), F.upper(F.substring("letters", 1, 16))), F.concat(F.lit("ghp_"), F.substring("letters", 1, 36)), F.concat(F.lit("xoxb-"), F.substring("letters", 1, 24)), F.concat(F.lit("AIza"), F.substring("letters", 1, 35))))
    texts = _once(texts, "secret", F.when(draw(12, 4) == 0, F.col("issued")).otherwise(pick(7, F.substring(h(4), 1, 40), F.substring(h(5), 1, 32), h(6), F.substring("base64", 1, 40), F.substring("letters", 1, 24), password)))
    texts = _once(texts, "harmless", pick(13, "changeme", "your_token_here", "example-token-0000", "xxxxxxxxxxxx", "placeholder", "YOUR_API_KEY", "required", "undefined", "string", "os.environ", "dummy-secret-1", "sample_password"))
    uuid = F.concat_ws("-", F.substring(h(14), 1, 8), F.substring(h(14), 9, 4), F.concat(F.lit("4"), F.substring(h(14), 13, 3)), F.concat(F.lit("a"), F.substring(h(14), 17, 3)), F.substring(h(14), 21, 12))
    number = F.substring(F.concat(F.conv(F.substring(h(15), 1, 15), 16, 10), F.conv(F.substring(h(15), 16, 15), 16, 10)), 1, 18)
    texts = _once(texts, "opening", F.concat(pick(9, "token", "password", "api_key", "secret", "API_KEY", "auth_token", "access_key", "pwd"), pick(11, " = ", ": ", "=", " : ")))
    quote, nothing = pick(10, '"', "'", ""), F.lit("")
    case = lambda label, value, before, after=nothing: F.struct(F.concat(before, value, after).alias("snippet"), value.alias("value"), F.lit(label).alias("label"))
    assigned = lambda label, value: case(label, value, F.concat("opening", quote), quote)
    worded = F.regexp_replace("secret", "[:/@]", "Z")
    texts = _once(texts, "case", pick(
        19, assigned(1, F.col("secret")), assigned(1, F.col("secret")), case(1, F.col("issued"), nothing), case(1, worded, F.lit("postgres://admin:"), F.lit("@db.local")),
        case(1, F.col("letters"), F.lit("Authorization: Bearer ")), assigned(0, F.col("harmless")), assigned(0, F.col("harmless")), case(0, F.substring(h(17), 1, 40), pick(16, "commit ", "sha1 ", "rev=")),
        case(0, h(18), F.lit("sha256:")), case(0, uuid, pick(16, "id: ", "uuid=", "ref ")), case(0, number, pick(16, "order ", "tel ", "")),
    ))
    found = _once(texts, "at", F.floor(draw(20, 1_000_003) / 1_000_003 * F.length("text")).cast("int"))
    whole = F.concat(F.substring("text", F.lit(1), F.col("at")), F.lit(" "), F.col("case.snippet"), F.lit(" "), F.substring("text", F.col("at") + 1, F.length("text")))
    return found.select("path", whole.alias("text"), F.col("case.value").alias("planted"), F.col("case.label").alias("label"))


@dataclass
class Forest:
    """A trained forest as data, with the dictionary its features need."""

    dictionary: list[str]
    trees: list[dict[str, list]]

    def score(self, f: Column) -> Column:
        """Share of the trees that call the candidate with the feature array f a secret.

        The trees are one constant; each is walked from its root as many steps as a tree is deep, and a leaf leads to
        itself. So the expression has the same size for any forest.
        """
        forest = F.from_json(F.lit(json.dumps(self.trees)), "array<struct<feature: array<int>, most: array<double>, yes: array<int>, no: array<int>, value: array<double>>>")

        def vote(t: Column) -> Column:
            step = lambda n, _: F.when(f[t["feature"][n]] <= t["most"][n], t["yes"][n]).otherwise(t["no"][n])
            return t["value"][F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), step)]

        return F.aggregate(forest, F.lit(0.0), lambda s, t: s + vote(t)) / len(self.trees)


def _tree(lines: str) -> dict[str, list]:
    """Spark's description of a tree as arrays by node."""
    rest = [x.strip() for x in lines.strip().split("\n")]
    out: dict[str, list] = {k: [] for k in ("feature", "most", "yes", "no", "value")}

    def node() -> int:
        me, line = len(out["value"]), rest.pop(0)
        for k, v in (("feature", 0), ("most", 0.0), ("yes", me), ("no", me), ("value", 0.0)):
            out[k].append(v)
        if found := re.match(r"Predict: ([\d.]+)", line):
            out["value"][me] = float(found[1])
            return me
        i, at = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
        out["feature"][me], out["most"][me] = int(i), float(at)
        out["yes"][me] = node()
        rest.pop(0)
        out["no"][me] = node()
        return me

    node()
    return out


def dictionary(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The words that a share of DICTIONARY_SHARE of all documents or more have. Counted over all documents by one aggregate."""
    texts = F.coalesce(F.col(text_col), F.lit(""))
    ws = docs.select(F.explode(F.array_distinct(F.split(F.lower(texts), r"[^a-z]+"))).alias("w")).filter(F.length("w") >= LEAST_LETTERS)
    least = max(2, int(DICTIONARY_SHARE * docs.count()))
    return sorted(r["w"] for r in ws.groupBy("w").count().filter(F.col("count") >= least).select("w").collect())


def train(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> Forest:
    """Fits the forest on labelled findings: columns id_col, value and is_secret, or else findings planted in the documents.

    For planting, about PLAIN_DOCS different texts without a name or format that secrets have are drawn by a hash of
    the text, each used as often as makes PLANTED findings; what was planted has the label it was planted with, and the
    other candidates of these texts are no secrets. Of each label TRAINING_FINDINGS different values are used at most, drawn
    by a hash, in an order that does not depend on partitions. The dictionary is counted over all documents. Fitting is Spark ML's; the
    trees become a column expression. Without findings of both labels (an empty table) no tree is grown and nothing is found.
    """
    text, path = F.coalesce(F.col(text_col), F.lit("")), F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), text.alias("text"))
    if labelled is not None:
        named = labelled.select(F.col(id_col).cast("long").alias("doc_id"), "value", F.col("is_secret").cast("int").alias("label")).filter("label in (0, 1)")
        chosen = named.orderBy(F.xxhash64("doc_id", "value"), "doc_id", "value", "label").limit(2 * TRAINING_FINDINGS)
        drawn = table(found.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"), "secret-sample")
        rows = _candidates(drawn).select("doc_id", "path", F.explode("candidates").alias("c")).withColumn("value", F.col("c.value"))
        rows = rows.join(F.broadcast(chosen), ["doc_id", "value"]).select("path", "c", "label")
    else:
        n, parts = max(1, docs.count()), 1_000_003
        drawn = found.filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(parts)) < F.lit(min(1.0, PLAIN_DOCS / n) * parts)).filter((F.col("text") != "") & ~F.col("text").rlike(_LIKELY))
        drawn = table(drawn.groupBy(F.md5("text").alias("h")).agg(F.min("path").alias("path"), F.min("text").alias("text")).drop("h"), "secret-sample")
        turns = -(-PLANTED // max(1, drawn.count()))
        cases = table(planted(drawn.select("path", "text", F.explode(F.sequence(F.lit(1), F.lit(min(turns, PLANTED)))).alias("turn"))), "secret-planted")
        rows = _candidates(cases).select("path", "planted", F.explode("candidates").alias("c"), "label")
        rows = rows.select("path", "c", F.when(F.contains("c.hit", "planted"), F.when(F.col("c.value") == F.col("planted"), F.col("label"))).otherwise(0).alias("label")).filter("label is not null")
    ws = dictionary(docs, text_col)
    rows = rows.withColumn("v", F.col("c.value")).groupBy("v", "label").agg(F.min_by(F.struct("path", "c"), F.xxhash64("path", "c")).alias("r"))
    few = [rows.filter(F.col("label") == y).orderBy(F.xxhash64("v"), "v").limit(TRAINING_FINDINGS) for y in (0, 1)]
    rows = few[0].unionByName(few[1]).select("label", F.col("r.path").alias("path"), F.col("r.c").alias("c"))
    cases = rows.select(F.col("label").cast("double").alias("label"), *(f.alias(n) for n, f in zip(FEATURES, features(F.col("c"), F.col("path"), ws))))
    cases = table(cases.repartition(1).sortWithinPartitions("label", *FEATURES), "secret-cases")
    if cases.select("label").distinct().count() < 2:
        return Forest(ws, [])
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(cases)
    model: RandomForestClassificationModel = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=32, seed=7, featureSubsetStrategy="sqrt").fit(data)
    return Forest(ws, [_tree(t.toDebugString.split("\n", 1)[1]) for t in model.trees])


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per secret: doc_id, start (from 0, in characters), length, value, score.

    Every whole text is searched by CANDIDATE; each candidate is scored by the forest and stays if its score reaches
    the threshold. Candidates inside longer words of junk count by the run of secret characters alone. All steps are
    built-in functions; there is no shuffle.

    Null and empty texts have no findings; null paths count as empty; null ids and repeated rows give their findings
    each; an empty table gives an empty result; other columns are ignored.
    """
    rows = findings(docs, id_col, text_col, path_col)
    # where a candidate starts: what lies before it in the array of (skip + whole length), summed for the findings alone
    lengths = F.transform("candidates", lambda c: c["skip"] + F.length(c["hit"]))
    kept = F.filter(F.transform(_scored(forest), lambda x, i: F.struct(i.alias("i"), x["c"]["skip"].alias("skip"), F.length(x["c"]["name"]).alias("name"), x["c"]["value"].alias("value"), x["score"].alias("score"))), lambda x: x["score"] >= threshold)
    rows = rows.select("doc_id", lengths.alias("lengths"), F.explode_outer(kept).alias("c")).filter(F.col("c").isNotNull())
    before = F.aggregate(F.slice("lengths", F.lit(1), F.col("c.i")), F.lit(0).cast("long"), lambda s, x: s + x)
    start = before + F.col("c.skip") + F.col("c.name")
    return rows.select("doc_id", start.alias("start"), F.length("c.value").cast("long").alias("length"), F.col("c.value").alias("value"), F.col("c.score").alias("score"))


def _scored(forest: Forest) -> Column:
    """The column of candidates with their scores: an array of structs c, score."""
    if not forest.trees:
        return F.transform("candidates", lambda c: F.struct(c.alias("c"), F.lit(0.0).alias("score")))
    described = F.transform("candidates", lambda c: F.struct(c.alias("c"), F.array(*features(c, F.col("path"), forest.dictionary)).alias("f")))
    return F.transform(described, lambda x: F.struct(x["c"].alias("c"), forest.score(x["f"]).alias("score")))


def redact(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, mark: str = "<secret>") -> DataFrame:
    """The documents with every secret of scan() replaced by a mark; all rows and other columns stay as they are.

    Nothing is shuffled: each text is put together again from its pieces and candidates. Null texts stay null.
    """
    path = F.coalesce(F.col(path_col).cast("string") if path_col else F.lit(None).cast("string"), F.lit(""))
    rows = _candidates(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), path.alias("path"), F.col(text_col).alias("text")))
    piece = lambda x: F.concat(F.when(x["score"] >= threshold, F.concat(x["c"]["name"], F.lit(mark))).otherwise(x["c"]["hit"]), x["c"]["rest"])
    clean = F.when(F.col("candidates").isNotNull(), F.concat("head", F.array_join(F.transform(_scored(forest), piece), ""))).otherwise(F.col("text"))
    return rows.select(F.col("row").withField(text_col, clean).alias("row")).select("row.*")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return scan(docs, train(docs))


SQL: dict[str, str] = {}
QUERIES = {"op7_secrets": op7_secrets}
