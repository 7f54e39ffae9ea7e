"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of key-like characters (letters, digits, + / _ - and closing = signs): any run
of at least 12 with a digit, any of at least 24, and any of at least 4, digits or not, that a
secret's name is assigned to (`password: Tr0ub4dor`). Each run of a word is a finding of its own, so
minified JSON, CSV, query strings and JWTs are scored piece by piece. The forest sees

- its length and what it is made of,
- its character transitions: the mean log-probability of its letter pairs, learned from all words
  of the corpus (`learn_words`; a fixed list of words counts half as much as the whole corpus), and
  the share of its neighbours that are letter pairs,
- dictionary coverage: how much of it frequent words of the corpus and of a fixed list cover,
- the path it stands in, and the name that it is assigned to,
- its neighbouring words, the name's pieces and the path's, hashed into WORD_BUCKETS features.

It is trained from labelled findings (`word`, `before`, `after`, `label`); `rule_findings` makes
such a table from public key shapes and look-alikes (checksums, ids, versions, dates, words) where
none is at hand. No feature tests for such a shape. Everything runs as column expressions and the
DataFrame API of pyspark.ml. A value with other signs inside (`ab&cd`) is several runs, each scored
alone.

Null and empty texts have no candidate; a very long text or word is read in steps linear in its
length; equal findings get equal scores, and a score at the threshold is a secret; every occurrence
is one finding, by its word number and its place among the pieces of the word; repeated rows are
scanned each; other columns are kept by `redact`, which replaces findings where they stand; empty
tables stay empty. `scan` adds an underscore to columns of its own that a key is named like.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, shared_table, table

# Names that go with secrets, words that go with look-alikes, words of a dictionary.
SECRET_NAMES = "pass|pwd|secret|token|apikey|api_key|api-key|access|auth|bearer|credential|private"
PLAIN_NAMES = "sha|md5|checksum|digest|commit|revision|uuid|guid|version|build|isbn|serial|order|invoice|phone|page|item|date|id$"
#: Common words of English and of technical texts, of three letters or more, and a few endings.
WORDS = """
able about above accept access account across action active actual add address admin after again against age ago agree air alert alias all allow
almost alone along already also always among amount and animal another answer any api app appear application apply area argument army around array
arrive art article ask asset async attempt attribute audio auth author auto available average away baby back backup bad bank bar base basic batch
battery bearer beat beautiful because become been before began begin behind being believe below best better between beyond big binary bit black block
blog blue board body book boolean border both bottom box boy branch bread break bring broken brother browser buffer bug build building business but
button buy byte cache call came can cancel car card care carry case catch category cause cell center central certain change changed changeme channel
char character charge chart check checksum child children choice choose city class clean clear click client clock close cloud code cold collection
color column come command comment commit common community company compare complete component computer condition config configuration connect
connection consider console constant consumer contact container content context continue control cookie copy core correct cost could count country
course cover create created credential cross cup current customer daily dark data database date day days dead dead deal debug december decide deep
default define delete demo depend deploy depth describe description design desk detail develop device did different digest digit direct directory
disable disk display doc docs document does dog domain done door double down download draft drive driver drop dry dummy during each early earth east
easy edge edit editor effect egg eight either element else email empty enable encode end engine english enough enter entry environment equal error
even evening event ever every exact example except execute exist expect expired export expression extra eye face fact factory fail failed fall false
family far farm fast father feature february feel feet fetch few field figure file fill filter final find fine finish fire first fish five fix flag
flat float floor flow folder follow food foot footer for force forest form format forward found four frame free friday friend from front full function
future game garden gate gateway gave general generate get girl give given global gold gone good goods graph gray great green ground group grow guest
guide had hair half hand happen happy hard has hash have head header health hear heart heavy height held hello help her here hidden high hill him his
history hold holder home hope horse host hot hour hours house how however http https human hundred husband icon idea image import inch include increase
index info information initial inner input insert inside install instance integer interest interface internal into invalid invoice island issue item
items its january job join json just keep key keys kind king knew know label land language large last late later latest law layer layout learn least
leave left length less let letter level library license life light like limit line link linux list listen listing little live load local location lock
log logger login logo long look loop lorem lost lot love low lower machine made mail main make man manager many map mark market master match material
matter max may maybe mean measure media meet member memory men menu merge message metadata meter method middle might mind minute missing mobile mode
model modern module moment monday money monitor month more morning most mother mount mountain move movement much multi music must mutable name names
nation native near need network never new news next night nine node none normal north not note nothing notice november now null number numbers object
october off offer office offset often old once one online only open operation operator option optional orange order organization origin other our out
output outside over own owner package page pages paint pair panel paper paragraph parameter parent parse part party pass passage password past patch path pattern
pay payload payment people per perhaps period person phone phrase picture piece pipe place placeholder plain plan plane plant platform play player please plugin
point policy poor port position possible post pound power prefix prepare present press pretty preview previous price primary print private problem
process produce product production profile program project promise property protocol provide proxy public publish pull purchase push put python quality
query question queue quick quiet quite random range rate rather raw reach read reader ready real reason receive recent record red redirect reduce
reference region register regular reject release remain remember remote remove render repeat replace report repository request require required reset resource
response rest result return reverse review rich right river road rock role roll room root rose round route router row rule run runtime safe said sale
same sample saturday save schedule schema scheme school science scope score screen script sea search season second secret section secure security see
seem segment select self sell send sense sent sentence separate september sequence serial series serve server service session set setting settings
seven several shadow shape share she shell ship shop short should show side sign signal signature simple since single sister site six size skill skip sky sleep
slot slow small snow social socket soft software some son song soon sort sound source south space special speed spring square stack staff stage stand
standard star start state statement static station status stay step still stock stone stop storage store story stream street string strong structure
student style subject submit success such suffix summary summer sun sunday supply support sure surface switch symbol sync system table tag take talk
target task teach team tell template temporary ten term test text than thank that the their them theme then there these they thing think third this
those thousand thread three through thursday time times timestamp title today together token tool top total touch toward town trace track trade train
tree trigger true try tuesday turn two type unable under undefined union unique unit unknown until update upload upper url usage use user username usual
utility valid validate value values variable vector vendor verify version very video view virtual visit voice volume wait walk wall want war warm
warning was watch water way weather web website wednesday week weight well went were west what wheel when where whether which while white who whole why wide width
wife wild will wind window windows winter wish with within without woman women wood word words work worker world worth would wrapper write writer
written wrong year years yellow yes yesterday yet you young your yourself zero zone ing tion ment ness ipsum www sha guid uuid
"""
#: Key-like characters; a run can close with = signs that nothing is assigned by.
K = "A-Za-z0-9+/_-"
#: Where blanks begin and end, and where runs begin and end: splitting there loses no character.
BLANKS = r"(?<=\s)(?=\S)|(?<=\S)(?=\s)"
RUNS = rf"(?<![{K}])(?=[{K}])|(?<=[{K}])(?![{K}])(?!={{1,2}}(?![={K}]))|(?<=[{K}]={{1,2}})(?![={K}])"
#: A run is looked at if it has 12 characters and a digit, or 24, or if it follows a secret's name and =, : or =>.
LONG = rf"(?<![{K}])(?:(?=[A-Za-z+/_-]*[0-9])[{K}]{{12,}}|[{K}]{{24,}})"
ASSIGN = r"""["'\\\])]{0,3}\s{0,3}(?:=>|:=|[:=])\s{0,3}["'\\\[(]{0,3}"""
SECRET_ASSIGN = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer)[0-9_-]{0,3}" + ASSIGN
NAMED = rf"{SECRET_ASSIGN}[{K}]{{4,}}"
#: Characters of context on each side of a run.
AROUND = 80
FEATURES = ("length", "digits", "upper", "lower", "signs", "turns", "distinct", "hexlike", "pairs", "likely", "known", "covered", "named", "named_key", "plain", "assigned", "path")
TREES, DEPTH, EXAMPLES, THRESHOLD, WORD_BUCKETS = 30, 8, 3600, 0.5, 64
#: Bits of the table of known words; a known word occurs so often and makes up such a share of all words, so there are at most 100,000.
WORD_BITS, LEAST_COUNT, LEAST_SHARE = 1 << 17, 5, 1e-5


@dataclass
class Words:
    """What the words of a corpus say: log-probabilities of letter pairs (a * 27 + b) and bits of known words."""

    pairs: list[float]
    bits: list[int]

    def pair_table(self) -> Column:
        return F.split(F.lit(",".join(f"{x:.6f}" for x in self.pairs)), ",").cast("array<double>")

    def bit_table(self) -> Column:
        return F.split(F.lit(",".join(map(str, self.bits))), ",").cast("array<bigint>")


@dataclass
class Scanner:
    words: Words
    forest: object


def learn_words(docs: DataFrame) -> Words:
    """Letter pairs and frequent words of all texts. The driver gets at most 676 sums and 100,000 words' buckets."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter(F.col("w").rlike("^[a-z]{2,24}$"))
    words = shared_table(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    letters = words.select("w", "n", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i"))
    at = lambda i: F.ascii(F.substring("w", i, F.lit(1))) - 96
    sums = {(r[0], r[1]): r[2] for r in letters.groupBy(at(F.col("i")).alias("a"), at(F.col("i") + 1).alias("b")).agg(F.sum("n")).collect()}
    fixed = Counter((ord(x) - 96, ord(y) - 96) for w in WORDS.split() for x, y in zip(w, w[1:]))
    weight = {p: sums.get(p, 0) / max(1, sum(sums.values())) + 0.5 * fixed[p] / sum(fixed.values()) + 1e-6 for p in itertools.product(range(1, 27), repeat=2)}
    pairs = [0.0] * 27 * 27
    for a in range(1, 27):
        of = sum(weight[a, b] for b in range(1, 27))
        for b in range(1, 27):
            pairs[a * 27 + b] = math.log(weight[a, b] / of)
    total = words.agg(F.sum("n")).first()[0] or 0
    bits = [0] * (WORD_BITS // 64)
    often = words.filter((F.length("w") >= 3) & (F.col("n") >= LEAST_COUNT) & (F.col("n") >= LEAST_SHARE * total))
    for r in often.select(_bit(F.col("w")).alias("bit")).distinct().collect():
        bits[r[0] // 64] |= 1 << (r[0] % 64)
    return Words(pairs, [x - (1 << 64) if x >> 63 else x for x in bits])


def _bit(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(WORD_BITS)).cast("int")


def _any_of(words: list[str]) -> str:
    """A pattern of the longest of the words: alternatives share their first letters, so it is walked and not tried word by word."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        more = [c + pattern(at[c]) for c in sorted(at) if c]
        if not more:
            return ""
        return f"(?:{'|'.join(more)})" + ("?" if "" in at else "")

    return pattern(tree)


DICTIONARY = _any_of(WORDS.split())


def features(df: DataFrame, words: Words) -> DataFrame:
    """The forest's features of (value, left, right), and neighbours: the words around, each with its place."""
    n = F.greatest(F.length("value"), F.lit(1)).cast("double")
    df = df.withColumns({
        "before": F.regexp_extract("left", r"((?:\S+\s+){0,2})\S*\z", 1), "after": F.lower(F.regexp_extract("right", r"^\S*\s+(\S+)", 1)),
        "name": F.regexp_extract("left", r"([A-Za-z0-9_.-]{2,40})" + ASSIGN + r"\z", 1),
        "word": F.concat(F.regexp_extract("left", r"(\S*)\z", 1), F.col("value"), F.regexp_extract("right", r"^(\S*)", 1)),
        "codes": F.transform(F.split(F.lower("value"), ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 96).otherwise(0)),
        "runs": F.filter(F.split(F.lower("value"), "[^a-z]+"), lambda w: F.length(w) >= 3),
    })
    others = F.greatest(F.size("codes") - 1, F.lit(0))
    pairs = F.filter(F.zip_with(F.slice("codes", F.lit(1), others), F.slice("codes", F.lit(2), others), lambda a, b: F.when((a > 0) & (b > 0), a * 27 + b)), lambda x: x.isNotNull())
    df = df.withColumn("letter_pairs", pairs)
    add = lambda a, x: a + x
    likely = F.aggregate(F.transform("letter_pairs", lambda x: F.get(words.pair_table(), x)), F.lit(0.0), add) / F.size("letter_pairs")
    is_known = lambda w: F.call_function("shiftright", F.get(words.bit_table(), (_bit(w) / 64).cast("int")), _bit(w) % 64).bitwiseAND(1)
    kept = lambda pattern: F.length(F.regexp_replace("value", pattern, "")) / n
    name = F.lower(F.concat_ws(" ", F.trim("before"), F.col("name")))
    flag = lambda c: c.cast("double")
    cols = {
        "length": n,
        "digits": kept(r"[^0-9]"),
        "upper": kept(r"[^A-Z]"),
        "lower": kept(r"[^a-z]"),
        "signs": kept(r"[A-Za-z0-9]"),
        "turns": F.length(F.regexp_replace(F.regexp_replace("value", r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])", "\u0001"), "[^\u0001]", "")) / n,
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "hexlike": flag(F.col("value").rlike("^[0-9a-f]+$")),
        "pairs": F.size("letter_pairs") / n,
        "likely": F.when(F.size("letter_pairs") > 0, likely).otherwise(-6.0),
        "known": F.aggregate(F.transform("runs", lambda w: F.length(w) * is_known(w)), F.lit(0).cast("bigint"), add) / n,
        "covered": 1 - F.length(F.regexp_replace(F.lower("value"), DICTIONARY, "")) / n,
        "named": flag(name.rlike(SECRET_NAMES)),
        "named_key": flag(F.lower("name").rlike(SECRET_NAMES)),
        "plain": flag(name.rlike(PLAIN_NAMES)),
        "assigned": flag(F.col("left").rlike(ASSIGN + r"\z")),
        "path": flag(F.col("word").rlike(r"://|\.[a-z]{2,4}\b|/[A-Za-z0-9_.-]+/|@")),
    }
    placed = lambda c, mark: F.transform(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: F.length(w) >= 2), lambda w: F.concat(F.lit(mark), w))
    around = F.concat(placed(F.col("before"), "before "), placed(F.col("name"), "name "), placed(F.col("after"), "after "), placed(F.regexp_extract("left", r"(\S*)\z", 1), "path "), placed(F.regexp_extract("right", r"^(\S*)", 1), "path "))
    return df.withColumns(cols | {"neighbours": around})


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.feature import HashingTF, VectorAssembler

    rows = HashingTF(numFeatures=WORD_BUCKETS, binary=True, inputCol="neighbours", outputCol="hashed").transform(rows)
    return VectorAssembler(inputCols=[*FEATURES, "hashed"], outputCol="secret_features").transform(rows)


def rule_findings(spark: SparkSession, examples: int = EXAMPLES) -> DataFrame:
    """Labelled findings built from hashes: word, before, after, label (1: a secret)."""
    i, h = F.col("id"), F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")).cast("binary"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[=]", "")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (F.pmod(F.xxhash64(i, F.lit(n)), F.lit(len(v))) + 1).cast("int"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    joined = lambda *v: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in v))
    url64, size = F.translate(b64, "+/", "-_"), (F.pmod(F.xxhash64(i, F.lit(30)), F.lit(6)) + 6).cast("int")
    mixed = F.translate(F.substring(b64, F.lit(1), size), "+/", "x7")
    letters = F.translate(mixed, "0123456789", "qzkvjxwpgb")
    word = lambda n: pick(n, "required", "please", "example", "changed", "never", "reset", "policy", "value", "string", "default", "document", "service", "optional", "expired")
    kinds = [
        (1, F.concat(F.lit("AKIA"), F.translate(F.upper(F.substring(b64, 1, 16)), "+/", "XY")), pick(1, "key is", "of the", "an and", "use")),
        (1, F.concat(pick(2, "password=", "passwd=", "pwd=", "secret="), F.substring(h, 1, 18)), pick(3, "and with", "the", "thing", "or")),
        (1, quoted(F.substring(h, 1, 40)), pick(4, "token =", "secret =", "auth_token :", "api_key =")),
        (1, F.concat(F.lit("ghp_"), F.translate(F.substring(b64, 1, 36), "+/", "Qw")), pick(5, "the", "token", "with")),
        (1, F.concat(F.lit("sk-"), F.translate(F.substring(b64, 1, 32), "+/", "ab")), pick(6, "key", "Bearer", "is")),
        (1, F.substring(b64, 1, 40), pick(7, "secret_access_key =", "aws secret =", "password:", "private key =")),
        (0, F.substring(h, 1, 40), pick(8, "commit", "sha1", "revision", "checksum =")),
        (0, F.substring(h, 1, 32), pick(9, "md5", "digest:", "file", "uuid")),
        (0, F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), pick(10, "id", "uuid =", "the", "order")),
        (0, F.concat(pick(11, "password=", "token=", "api_key="), pick(12, "changeme123456", "example-value-1", "your_password_1", "placeholder0000", "test-token-12345")), pick(13, "set", "the", "with")),
        (0, F.concat(F.lit("http://www.example.com/"), F.substring(h, 1, 12), pick(14, "/index1.html", "/page2", "/img3.png")), pick(15, "see", "at", "link")),
        (0, F.conv(F.substring(h, 1, 13), 16, 10), pick(16, "number", "the", "call", "item")),
        (0, F.concat(pick(17, "version-", "release_", "model-number-", "document-"), F.conv(F.substring(h, 1, 6), 16, 10), F.lit("-final")), pick(18, "the", "file", "of")),
        (0, F.concat(F.lit("+1-555-"), F.conv(F.substring(h, 1, 6), 16, 10), F.lit("-000")), pick(19, "call", "phone", "the")),
        (1, joined('{"user":"bob","', pick(20, "access_token", "password", "api_key", "client_secret"), '":"', F.substring(url64, 1, 32), '","n":1}'), pick(21, "got", "the", "body")),
        (1, joined("eyJhbGciOiJIUzI1NiJ9.eyJ", F.substring(url64, 1, 36), ".", F.substring(F.reverse(url64), 1, 42)), pick(22, "Bearer", "token:", "the", "jwt")),
        (1, joined("https://api.test.org/cb?n=1&", pick(23, "access_token=", "token=", "api_key="), F.substring(h, 1, 32), "&lang=en"), pick(24, "open", "the", "at")),
        (1, joined("AKIA", F.translate(F.upper(F.substring(b64, 1, 16)), "+/", "XY"), ",", F.substring(F.reverse(b64), 1, 40)), pick(25, "row", "keys", "the")),
        (1, mixed, pick(26, "password:", "passwd =", "secret:", "db_password:", "pwd =")),
        (1, F.when(size % 2 == 0, F.lower(letters)).otherwise(letters), pick(27, "password:", "token =", "secret:", "pwd:")),
        (0, word(28), pick(29, "password:", "token:", "secret =", "api_key:", "auth:")),
        (0, joined(pick(31, '{"token":"', '{"password":"', '{"secret":"'), word(32), word(33), '","id":7}'), pick(34, "got", "the", "body")),
        (0, joined('{"order_id":"', F.conv(F.substring(h, 1, 13), 16, 10), '","sha":"', F.substring(h, 14, 40), '"}'), pick(35, "got", "the", "body")),
        (0, joined(word(36), word(37), "-", F.conv(F.substring(h, 1, 3), 16, 10)), pick(38, "the", "file", "and", "of")),
        (1, F.substring(h, F.lit(1), F.pmod(F.xxhash64(i, F.lit(39)), F.lit(33)).cast("int") + 24), pick(40, "client_secret:", "api-key:", "authToken =", "SECRET_KEY=", "x-api-key:")),
        (1, joined(pick(41, "postgres://app:", "mysql://root:", "https://bot:"), mixed, "@db.example.org:5432/main"), pick(42, "url", "dsn =", "connect to", "the")),
        (1, joined("xoxb-", F.conv(F.substring(h, 1, 8), 16, 10), "-", F.substring(url64, 1, 24)), pick(43, "slack", "bot token", "the", "use")),
        (1, joined(F.substring(b64, 1, 42), F.lit("==")), pick(44, "private_key:", "Authorization: Basic", "shared_secret =", "credential:")),
        (0, F.substring(h, 1, 64), pick(45, "sha256:", "digest =", "sha256sum", "integrity")),
        (0, joined("data:image/png;base64,", b64, F.reverse(b64)), pick(46, "img src=", "background:", "the", "icon")),
        (0, joined(pick(47, "https://cdn.example.net/assets/", "/var/log/app/", "s3://bucket/data/"), F.substring(h, 1, 20), pick(48, ".js", ".log", ".parquet")), pick(49, "load", "open", "the", "from")),
        (0, joined(pick(50, "get", "set", "is", "make"), F.initcap(word(51)), F.initcap(word(52)), F.initcap(word(53))), pick(54, "call", "method", "function", "def")),
        (0, joined(word(55), F.lit("_"), word(56), F.lit("_"), word(57), F.lit("_2")), pick(58, "the", "table", "column", "variable")),
        (0, joined("2024-", F.lpad(F.pmod(i, F.lit(12)).cast("string"), 2, "0"), "-17T", F.substring(F.conv(F.substring(h, 1, 8), 16, 10), 1, 6), "Z"), pick(59, "at", "date:", "since", "time =")),
        (0, joined("v", F.pmod(i, F.lit(30)).cast("string"), ".", F.pmod(i, F.lit(7)).cast("string"), "-build", F.conv(F.substring(h, 1, 6), 16, 10)), pick(60, "version", "release", "build:", "tag")),
        (0, F.substring(h, 1, 24), pick(61, "object id", "trace_id:", "request-id:", "session", "etag =")),
        # words that no dictionary has, made of halves of others
        (0, joined(F.substring(word(63), 1, 4), F.substring(word(64), 4, 12)), pick(65, "password:", "the password:", "token =", "secret:", "auth:")),
        (0, joined(F.substring(word(66), 1, 3), F.substring(word(67), 3, 12)), pick(68, "passwd:", "the secret:", "token:", "credential:", "password:")),
    ]
    # one small plan for each kind: a choice among all of them would be too long for one generated method
    rows = None
    for k, (label, word, before) in enumerate(kinds):
        some = spark.range(k, examples, len(kinds), 1).select(word.alias("word"), before.alias("before"), pick(62, "the", "and", "was", "in", "then", "for").alias("after"), F.lit(label).alias("label"))
        rows = some if rows is None else rows.union(some)
    return rows.coalesce(4)


def train(findings: DataFrame, words: Words, trees: int = TREES, depth: int = DEPTH) -> Scanner:
    """The forest, from labelled findings (word, before, after, label) and the words of the corpus."""
    from pyspark.ml.classification import RandomForestClassifier

    texts = findings.select(F.concat_ws(" ", "before", "word", "after").alias("text"), F.col("label").alias("found_label"))
    rows = _vectors(features(candidates(texts, "found_label"), words)).select("secret_features", F.col("found_label").cast("double").alias("label"))
    rows = shared_table(rows.coalesce(4), "findings")  # trees read it many times
    forest = RandomForestClassifier(featuresCol="secret_features", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.4", seed=17)
    return Scanner(words, forest.fit(rows))


def _has_candidate(text: Column) -> Column:
    return F.coalesce(text.rlike(LONG) | text.rlike(NAMED), F.lit(False))


def candidates(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, word_no, run_no, value, left and right (what stands around it) of every candidate in whole texts.

    run_no is the place among the pieces of the word that RUNS splits. Texts are first split into
    words, candidate words into runs, and each step is linear in its length.
    """
    get = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
    near = lambda i: F.concat_ws(" ", *(F.right(get("t", i - d), F.lit(AROUND // 2)) for d in (6, 4, 2)))
    texts = docs.filter(_has_candidate(F.col("text"))).select(*keys, F.split("text", BLANKS).alias("t"))
    at = F.filter(F.transform("t", lambda x, i: F.when(x.rlike(LONG) | F.concat(near(i), F.lit(" "), x).rlike(NAMED), i)), lambda i: i.isNotNull())
    # blanks and words alternate; either can come first
    word = F.transform(at, lambda i: F.struct(((i + 1) / 2).cast("int").alias("word_no"), get("t", i).alias("x"), near(i).alias("near"), F.left(get("t", i + 2), F.lit(AROUND)).alias("next")))
    words = texts.select(*keys, F.explode(word).alias("w")).select(*keys, "w.*").withColumn("q", F.split("x", RUNS))

    def left(j: Column) -> Column:
        return F.right(F.concat("near", F.lit(" "), *(get("q", j - d) for d in range(6, 0, -1))), F.lit(AROUND))

    def run(y: Column, j: Column) -> Column:
        right = F.left(F.concat(*(get("q", j + d) for d in range(1, 5)), F.lit(" "), F.col("next")), F.lit(AROUND))
        taken = y.rlike("^" + LONG) | (y.rlike(rf"^[{K}]{{4,}}") & left(j).rlike(SECRET_ASSIGN + r"\z"))
        return F.when(taken, F.struct(j.alias("run_no"), y.alias("value"), left(j).alias("left"), right.alias("right")))

    runs = F.filter(F.transform("q", run), lambda r: r.isNotNull())
    return words.select(*keys, "word_no", F.explode(runs).alias("r")).select(*keys, "word_no", "r.*")


def scan(docs: DataFrame, scanner: Scanner, *keys: str, threshold: float = THRESHOLD) -> DataFrame:
    """keys and every candidate with its place, word, value, the forest's score and whether it is a secret."""
    from pyspark.ml.functions import vector_to_array

    own = {k: f"key {i}" for i, k in enumerate(keys)}
    rows = _vectors(features(candidates(docs.select(*(F.col(k).alias(c) for k, c in own.items()), "text"), *own.values()), scanner.words))
    scored = scanner.forest.transform(rows).withColumn("score", vector_to_array("probability")[1]).withColumn("is_secret", F.col("score") >= threshold)
    taken = {k.lower() for k in keys}
    return scored.select(*(F.col(c).alias(k) for k, c in own.items()), *(F.col(c).alias(c + "_" if c in taken else c) for c in ("word_no", "run_no", "word", "value", "score", "is_secret")))


def _replaced(pieces: Column, hits: Column, at, new) -> Column:
    """The pieces joined, with new(hit) in the place at(hit) of each hit; hits are in the order of their places."""
    past = lambda j: F.when(j == 0, F.lit(0)).otherwise(at(F.get(hits, j - 1)) + 1)
    parts = F.flatten(F.transform(hits, lambda x, j: F.concat(F.slice(pieces, past(j) + 1, at(x) - past(j)), F.array(new(x)))))
    end = F.slice(pieces, past(F.size(hits)) + 1, F.size(pieces))
    return F.array_join(F.concat(parts, end), "")


def redact(docs: DataFrame, scanner: Scanner, mark: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """docs with every confirmed secret in text replaced by mark where it stands, and n_chars counted anew.

    Texts without a candidate are passed on as they are; only the others meet their findings in a
    join by a hash of the whole text, so equal texts share their findings.
    """
    has = _has_candidate(F.col("text"))
    # SHA-256 names a text
    key, of, cut = free_name(docs, "secret_key"), free_name(docs, "secret_places"), free_name(docs, "secret_pieces")
    suspects = docs.filter(has).withColumn(key, F.sha2(F.col("text").cast("binary"), 256))
    found = scan(suspects.dropDuplicates([key]), scanner, key, threshold=threshold).filter("is_secret")
    found = found.groupBy(key, "word_no").agg(F.array_sort(F.collect_list("run_no")).alias("runs"))
    found = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("word_no", "runs"))).alias(of))
    done = suspects.join(found, key, "left")
    hit = F.col(of).isNotNull()
    done = done.withColumn(cut, F.when(hit, F.split("text", BLANKS)))
    place = lambda x: x["word_no"] * 2 - F.when(F.col("text").rlike(r"^\s"), F.lit(1)).otherwise(F.lit(0))
    # transform over one array names the word's pieces, which would be split anew for each use
    clear = lambda x: F.get(F.transform(F.array(F.split(F.get(F.col(cut), place(x)), RUNS)), lambda q: _replaced(q, x["runs"], lambda r: r, lambda r: F.lit(mark))), F.lit(0))
    done = done.withColumn("text", F.when(hit, _replaced(F.col(cut), F.col(of), place, clear)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return docs.filter(~has).unionByName(done.select(*docs.columns))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(rule_findings(spark), learn_words(docs)), "doc_id")
    return found.select("doc_id", "word_no", "run_no", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.length("value").alias("value_chars"), "score", "is_secret")
