"""Secret scans: long unbroken strings, told apart from harmless ones by a random forest.

Candidates are runs of at least ``SHORTEST`` characters as keys, tokens and hashes have them; prose, numbers
and names give many false ones. The forest judges each by its length, its character transitions (runs of
one class, and how well letters follow each other as in the corpus's words), the share of it that words of a
dictionary cover, the path it was found in, and the words beside it. It is trained from labelled findings.
Everything is DataFrame functions and Spark's own forest; no Python runs on the executors.

Labels come from a reviewed base of kinds (``reviewed_kinds``): secrets as services hand them out, bare or behind
a name, and what looks like them and is none, such as UUIDs, commits and checksums, hosts, paths and names. The
corpus adds its words, from which the base's examples are put together, its letter table, and its own harmless
findings. So both classes are always there, whatever the documents hold.

The dictionary and the letter table are the ``words`` most frequent words of all documents; the odds of
neighbouring words and the forest learn from the base and a bounded number of labelled findings (``per_class``). All
documents are scanned, and all candidates judged, whole.

Defined results: null and empty texts have no candidates; very long texts are searched, and very long candidates
judged, whole; a null path has no path features; repeated rows give repeated findings, and rows of equal or null
id are told apart by their texts; repeated rows teach once; an empty table gives an empty result; other columns,
of any name, are ignored by ``scan`` and kept by ``redact``.
"""

import json
from functools import reduce
from math import log2

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free, held_out
from .language import sample

SHORTEST = 16
CHARS = r"A-Za-z0-9_+/=~.\-"
CANDIDATE = rf"(?<![{CHARS}])[{CHARS}]{{{SHORTEST},}}+"
#: Words that name secrets, those that name digests of public things, and parts of paths that hold made-up ones.
NAMES = "token|secret|key|passw|pwd|auth|credential|bearer"
CHECKS = r"\bcommit|\brevision|\bparent|\btree|\bsha\d|\bmd5|checksum|digest|\bhash|\betag|\bblob|fingerprint|integrity|\buuid|\bguid"
HARMLESS_PATHS = "test|example|fixture|mock|vendor|lock|sample"
MASK = "[SECRET]"
BEFORE, AFTER = 48, 24
LETTERS = 27

FEATURES = ("length", "lower_share", "upper_share", "digit_share", "kinds_share", "transitions", "letter_bits", "coverage", "harmless_path", "path_bucket", "named", "assigned", "quoted", "word_odds", "follows_word", "separators", "longest_part", "hex_share", "checked")


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, key (a hash of id and text), path, start, stop, value, before, after of every candidate.

    The text is cut into chunks that end with a candidate each; what follows the last is looked up apart.
    Offsets are running sums of the chunks' lengths, over the candidates of one document.
    """
    text = F.col("text").cast("string")
    # Texts without a candidate leave by a plain search; the others are cut up.
    found = docs.where(text.rlike(CANDIDATE)).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("doc_id"), text).alias("key"),
        F.col(path).cast("string").alias("path"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?{CANDIDATE}"), F.lit(0)).alias("chunks"),
        text.alias("text"),
    )
    # What follows the last chunk is seen once the chunks' lengths are added up.
    ended = F.aggregate("chunks", F.lit(0), lambda n, x: n + F.length(x))
    found = found.withColumn("tail", F.substring(F.col("text"), ended + 1, F.lit(AFTER)))
    nexts = F.transform(F.slice("chunks", 2, F.size("chunks")), lambda x: F.left(x, F.lit(AFTER)))
    rows = found.select("doc_id", "key", "path", "row", F.posexplode(F.arrays_zip("chunks", F.concat(nexts, F.array("tail")).alias("nexts"))).alias("at", "x"))
    rows = rows.select("doc_id", "key", "path", "row", "at", F.col("x.chunks").alias("chunk"), F.col("x.nexts").alias("after")).withColumn("value", F.regexp_extract("chunk", rf"{CANDIDATE}$", 0))
    before = F.right(F.left("chunk", F.length("chunk") - F.length("value")), F.lit(BEFORE))
    rows = rows.select("doc_id", "key", "path", "row", "at", "value", before.alias("before"), "after", F.length("chunk").alias("size"))
    stop = F.sum("size").over(Window.partitionBy("key", "row").orderBy("at")).cast("int")
    return rows.select("doc_id", "key", "row", "path", (stop - F.length("value")).alias("start"), stop.alias("stop"), "value", "before", "after")


def last_word() -> F.Column:
    return F.lower(F.regexp_extract("before", r"(\p{L}+)[^\p{L}]*$", 1))


#: The dictionary's words have from 3 to so many letters.
LONGEST_WORD = 20
#: The candidate alphabet has 67 characters; that many kinds at most are expected of a long candidate.
ALPHABET = 64.0


def corpus_words(docs: DataFrame, words: int = 30_000) -> DataFrame:
    """The most frequent words of three letters and more, in lower case, with the number of documents that have them."""
    split = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<!\p{{L}})[a-z]{{3,{LONGEST_WORD}}}(?!\p{{L}})"), F.lit(0)))
    counted = docs.select(F.explode(split).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where("n > 1").orderBy(F.desc("n"), "word").limit(words)


def _letter_number(c: F.Column) -> F.Column:
    """0 for a to 25 for z, 26 for anything else."""
    at = F.ascii(c) - 97
    return F.when((at >= 0) & (at < 26), at).otherwise(26)


def letter_table(words: DataFrame) -> F.Column:
    """Bits of each letter after each other one, from the dictionary: an array of LETTERS * LETTERS numbers."""
    lettered = words.select(F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"), "word", "n")
    pair = _letter_number(F.substring("word", F.col("i"), F.lit(1))) * LETTERS + _letter_number(F.substring("word", F.col("i") + 1, F.lit(1)))
    counts = {r.pair: r.n for r in lettered.groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).collect()}  # 729 rows at most
    sums = [sum(counts.get(a * LETTERS + b, 0) for b in range(LETTERS)) for a in range(LETTERS)]
    bits = [-log2((counts.get(a * LETTERS + b, 0) + 1) / (sums[a] + LETTERS)) for a in range(LETTERS) for b in range(LETTERS)]
    return F.from_json(F.lit(str(bits)), "array<double>")


def featured(found: DataFrame, dictionary: DataFrame, table: F.Column, odds: DataFrame) -> DataFrame:
    """Adds FEATURES. The dictionary and the odds are bounded by their parameters and broadcast."""
    size = F.length("value").cast("double")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / size
    lowered = F.lower("value")
    runs = F.regexp_extract_all(lowered, F.lit("[a-z]{3,}"), F.lit(0))
    # Of each run of letters the longest beginning and the longest end that are words count as covered; no word of the dictionary is longer than LONGEST_WORD.
    # Of a candidate's equal runs one is looked up, with how often it occurs.
    counted = found.select("key", "row", "start", F.explode(runs).alias("run")).groupBy("key", "row", "start", "run").agg(F.count("*").alias("times"))
    pieces = counted.select("key", "row", "start", "run", "times", F.explode(F.sequence(F.lit(3), F.least(F.length("run"), F.lit(LONGEST_WORD)))).alias("n"))
    ends = pieces.select("key", "row", "start", "run", "times", "n", F.expr("left(run, n)").alias("head"), F.expr("right(run, n)").alias("end"))
    known = F.broadcast(dictionary.select("word"))
    hits = ends.join(known.withColumnRenamed("word", "head").withColumn("is_head", F.lit(1)), "head", "left").join(known.withColumnRenamed("word", "end").withColumn("is_end", F.lit(1)), "end", "left").where("is_head = 1 or is_end = 1")
    covered = hits.groupBy("key", "row", "start", "run", "times").agg((F.coalesce(F.max(F.when(F.col("is_head") == 1, F.col("n"))), F.lit(0)) + F.coalesce(F.max(F.when(F.col("is_end") == 1, F.col("n"))), F.lit(0))).alias("n"))
    covered = covered.groupBy("key", "row", "start").agg(F.sum(F.col("times") * F.least("n", F.length("run"))).alias("covered"))
    # Split once, as a lookup by position would take the square of a long token's length.
    numbers, n_pairs = F.transform(F.split(lowered, ""), _letter_number), F.length("value") - 1
    pairs = F.zip_with(F.slice(numbers, F.lit(1), n_pairs), F.slice(numbers, F.lit(2), n_pairs), lambda a, b: F.get(table, a * LETTERS + b))
    bits = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.greatest(n_pairs, F.lit(1))
    joined = found.join(covered, ["key", "row", "start"], "left").withColumn("word", last_word()).join(F.broadcast(odds), "word", "left")
    return joined.select(
        *found.columns,
        size.alias("length"),
        share("[a-z]").alias("lower_share"),
        share("[A-Z]").alias("upper_share"),
        share("[0-9]").alias("digit_share"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.least(size, F.lit(ALPHABET))).alias("kinds_share"),
        (F.regexp_count("value", F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) / size).alias("transitions"),
        bits.alias("letter_bits"),
        (F.coalesce("covered", F.lit(0)) / size).alias("coverage"),
        F.coalesce(F.lower("path").rlike(HARMLESS_PATHS), F.lit(False)).cast("double").alias("harmless_path"),
        F.coalesce(F.pmod(F.xxhash64("path"), F.lit(16)), F.lit(-1)).cast("double").alias("path_bucket"),
        F.lower("before").rlike(rf"({NAMES})\w*[^\w]{{0,6}}$").cast("double").alias("named"),
        F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double").alias("assigned"),
        (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double").alias("quoted"),
        F.coalesce("odds", F.lit(0.0)).alias("word_odds"),
        F.col("after").rlike(r"^[\"']?\s+\p{L}").cast("double").alias("follows_word"),
        share("[^A-Za-z0-9]").alias("separators"),
        F.coalesce(F.array_max(F.transform(F.regexp_extract_all("value", F.lit("[A-Za-z0-9]+"), F.lit(0)), F.length)), F.lit(0)).cast("double").alias("longest_part"),
        share("[0-9a-fA-F]").alias("hex_share"),
        F.lower("before").rlike(rf"({CHECKS})\w*[^\w]{{0,6}}$").cast("double").alias("checked"),
    )


def assigned_to_a_name() -> F.Column:
    return F.lower("before").rlike(rf"({NAMES})\w*[\"']?\s*[=:]\s*[\"']?$")


def weak_labels(found: DataFrame) -> DataFrame:
    """The corpus's own harmless findings: letters with dots and dashes only, or digits only, not assigned to a secret's name. All else is unlabelled and left out."""
    plain = F.col("value").rlike(r"^[A-Za-z.\-]+$") | F.col("value").rlike("^[0-9]+$")
    return found.where(plain & ~assigned_to_a_name()).withColumn("label", F.lit(0))


# Usual words, for names and sentences around findings where the corpus has few of its own.
COMMON_WORDS = "account after button change client config custom default display element engine error event example field file filter format global handler image index input label layout level library list local manager master message module name number object option order output package page parent pattern plugin point process profile query record region report request resource response result sample schema screen section server service session setting source status storage stream string style system table target template test text theme time title update user value version view widget window".split()


def with_common(dictionary: DataFrame) -> DataFrame:
    """The corpus's words, and the usual ones among which reviewed examples stand, as if two documents had them."""
    usual = dictionary.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(COMMON_WORDS)), "array<string>")).alias("word"), F.lit(2).cast("long").alias("n"))
    return dictionary.unionByName(usual).groupBy("word").agg(F.max("n").alias("n"))


def _of(*options: str):
    """SQL for one of the texts, drawn by a hash of the row."""
    return lambda salt: f"element_at(array({', '.join(repr(x) for x in options)}), cast(pmod(xxhash64(id, '{salt}'), {len(options)}) as int) + 1)"


def _drawn(kind: str) -> dict:
    """SQL for the parts of a kind of finding; each call of one draws anew, by a hash of the row's number."""
    calls = iter(range(10**6))
    salt = lambda: f"{kind} {next(calls)}"
    digest = lambda: f"sha2(concat('{salt()} ', id), 512)"
    part = lambda text, lo, hi: f"substring({text}, 1, {lo} + cast(pmod(xxhash64(id, '{salt()}'), {hi - lo + 1}) as int))"
    return {
        "hexed": lambda lo, hi=0: part(digest(), lo, hi or lo),
        "base64": lambda lo, hi=0: part(f"base64(unhex({digest()}))", lo, hi or lo),
        "alnum": lambda lo, hi=0: part(f"translate(base64(unhex({digest()})), '+/=', 'xQ7')", lo, hi or lo),
        "url64": lambda lo, hi=0: part(f"translate(base64(unhex({digest()})), '+/=', '-_A')", lo, hi or lo),
        "digits": lambda lo, hi=0: part(f"translate({digest()}, 'abcdef', '926174')", lo, hi or lo),
        "letters": lambda lo, hi=0: part(f"translate(base64(unhex({digest()})), '0123456789+/=', 'qzjxkvwfhbPLm')", lo, hi or lo),
        "word": lambda: f"element_at(words, cast(pmod(xxhash64(id, '{salt()}'), size(words)) as int) + 1)",
        "one": lambda *options: _of(*options)(salt()),
    }


def reviewed_kinds() -> list[tuple[str, int, list[str], str]]:
    """(kind, label, texts that may stand before, SQL of the value): kinds of findings that were looked through once, secret (1) and harmless (0).

    A kind is a rule from which any number of examples follows, with words of the corpus where people put words.
    """
    named = ["api_key = \"", "api_key: ", "secret=", "SECRET_KEY = \"", "access_token: \"", "token = \"", "auth_token=", "client_secret: ", "password = \"", "passwd=", "credentials: ", "Authorization: Bearer "]
    bare = ["", " ", " ", "the key is ", "with ", "see ", "and ", "value ", "> ", "\n", "- ", "is ", "(", "= "]
    check = ["commit ", "commit: ", "revision ", "parent ", "tree ", "sha1 = \"", "sha1: ", "sha256: ", "sha256 = \"", "sha256sum ", "md5: ", "md5 = \"", "MD5 (file) = ", "checksum: ", "checksum = \"", "digest ", "digest: sha256:", "hash ", "hash: ", "etag: \"", "blob ", "fingerprint ", "crc: ", "integrity: "]
    ids = ["", " ", "id: ", "id = \"", "uuid: ", "uuid = \"", "request ", "session id ", "guid ", "user ", "trace ", "device ", "see "]
    plain = ["", " ", "see ", "file = ", "name: ", "the ", "in ", "host ", "from ", "at ", "and ", "of ", "(", "\"", "url = \"", "class ", "import "]
    word_keys = ["key = \"", "token_type: \"", "keyword: ", "auth = ", "secret name: "]
    out = []

    def kind(name, label, before, value):
        out.append((name, label, before, value(_drawn(name))))

    for width in (32, 40, 64):
        kind(f"hex {width} of a name", 1, named, lambda d, n=width: d["hexed"](n))
        kind(f"hex {width}", 1, bare, lambda d, n=width: d["hexed"](n))
        kind(f"check {width}", 0, check, lambda d, n=width: d["hexed"](n))
    for where, before in (("of a name", named), ("bare", bare)):
        kind(f"alnum {where}", 1, before, lambda d: d["alnum"](20, 48))
        kind(f"base64 {where}", 1, before, lambda d: f"concat({d['base64'](38, 66)}, {d['one']('', '=', '==')})")
        kind(f"url64 {where}", 1, before, lambda d: d["url64"](24, 60))
        kind(f"jwt {where}", 1, before, lambda d: f"concat('eyJhbGciOiJ', {d['url64'](9, 25)}, '.eyJ', {d['url64'](20, 80)}, '.', {d['url64'](30, 43)})")
        kind(f"stripe {where}", 1, before, lambda d: f"concat({d['one']('sk_live_', 'sk_test_', 'rk_live_', 'pk_live_')}, {d['alnum'](20, 32)})")
        kind(f"prefixed {where}", 1, before, lambda d: f"concat({d['one']('ghp_', 'gho_', 'glpat-', 'npm_', 'hf_', 'AIza', 'xoxb-', 'SG.', 'key-', 'pat_')}, {d['alnum'](20, 40)})")
        kind(f"upper {where}", 1, before, lambda d: f"concat({d['one']('AKIA', 'ASIA')}, upper({d['alnum'](16)}))")
        kind(f"upper hex {where}", 1, before, lambda d: f"upper({d['hexed'](32, 40)})")
    kind("letters of a name", 1, named[:10], lambda d: d["letters"](16, 30))
    kind("lower letters of a name", 1, named[:10], lambda d: f"lower({d['letters'](18, 30)})")
    kind("alnum 16 of a name", 1, named, lambda d: d["alnum"](16, 22))
    kind("repeated of a name", 1, named, lambda d: f"repeat({d['hexed'](6, 16)}, 4)")
    kind("runs of a name", 1, named, lambda d: f"concat({d['digits'](4, 10)}, lower({d['letters'](4, 8)}), {d['digits'](4, 10)}, lower({d['letters'](4, 8)}), {d['digits'](4, 8)})")
    dashed = lambda d: f"concat_ws('-', {d['hexed'](8)}, {d['hexed'](4)}, {d['hexed'](4)}, {d['hexed'](4)}, {d['hexed'](12)})"
    kind("uuid", 0, ids, dashed)
    kind("uuid bare", 0, bare, dashed)
    kind("upper uuid", 0, ids, lambda d: f"upper({dashed(d)})")
    kind("integrity", 0, check, lambda d: f"concat({d['one']('sha512-', 'sha256-', 'sha384-')}, {d['base64'](43, 86)}, {d['one']('=', '==')})")
    joined = lambda d, n, sign: f"concat_ws('{sign}', {', '.join(d['word']() for _ in range(n))})"
    titled = lambda d, n: f"concat({', '.join('initcap(' + d['word']() + ')' for _ in range(n))})"
    for before, where in ((plain, "plain"), (word_keys, "of a key")):
        kind(f"snake {where}", 0, before, lambda d: joined(d, 3, "_"))
        kind(f"dashes {where}", 0, before, lambda d: joined(d, 3, "-"))
        kind(f"camel {where}", 0, before, lambda d: titled(d, 3))
    kind("snake and number", 0, plain, lambda d: f"concat({joined(d, 3, '_')}, '_', {d['digits'](1, 3)})")
    kind("camel and number", 0, plain, lambda d: f"concat({titled(d, 3)}, {d['digits'](1, 2)})")
    kind("constant", 0, plain, lambda d: f"upper({joined(d, 4, '_')})")
    kind("words run together", 0, plain, lambda d: joined(d, 4, ""))
    kind("long word", 0, [*plain, *bare], lambda d: f"concat({d['word']()}, {d['word']()}, {d['one']('ation', 'ness', 'isation', 'ingly', 'ments', 'ability')})")
    kind("dotted names", 0, plain, lambda d: joined(d, 4, "."))
    kind("path", 0, plain, lambda d: f"concat('/', {joined(d, 4, '/')}, {d['one']('.txt', '.py', '.html', '.json', '/')})")
    kind("path with numbers", 0, plain, lambda d: f"concat({d['word']()}, '/', {d['word']()}, {d['digits'](1, 3)}, '/v', {d['digits'](1, 2)}, '/', {d['word']()}, '-', {d['digits'](4)}, '.', {d['one']('csv', 'log', 'png', 'tar.gz')})")
    kind("address", 0, ["http:", "https:", "ftp:", "see https:"], lambda d: f"concat('//www.', {d['word']()}, '.', {d['one']('com', 'org', 'net')}, '/', {d['word']()}, '/', {d['word']()}, '-', {d['digits'](1, 4)})")
    kind("host", 0, plain, lambda d: f"concat({d['word']()}, {d['digits'](1, 3)}, '.', {d['word']()}, {d['one']('', '-')}, {d['word']()}, '.', {d['one']('com', 'net', 'internal', 'local', 'example.org')})")
    kind("numbered host", 0, plain, lambda d: f"concat({d['one']('ip-', 'ec2-', 'node-', 'db-', 'web')}, {d['digits'](1, 3)}, '-', {d['digits'](1, 3)}, '-', {d['digits'](1, 3)}, '.', {d['word']()}, '.', {d['word']()}, {d['digits'](1, 2)}, '.', {d['one']('com', 'net', 'internal')})")
    kind("digits", 0, plain + bare, lambda d: d["digits"](16, 30))
    kind("decimals", 0, plain + bare, lambda d: f"concat({d['digits'](1, 9)}, '.', {d['digits'](14, 18)})")
    kind("time", 0, plain, lambda d: f"concat({d['one']('2019-', '2023-', '2024-', '2025-')}, {d['one']('01-', '07-', '12-')}, {d['one']('03', '14', '28')}, {d['one']('T', '-', '_')}, {d['digits'](6, 8)}, {d['one']('Z', '', '.000Z', '-final')})")
    kind("dated name", 0, plain, lambda d: f"concat({d['one']('2023-01-31-', '2024_12_05_', '20240131-')}, {d['word']()}, {d['one']('-', '_')}, {d['word']()}, {d['one']('.pdf', '-v2', '')})")
    kind("version", 0, plain, lambda d: f"concat({d['word']()}, '-', {d['digits'](1, 2)}, '.', {d['digits'](1, 2)}, '.', {d['digits'](1, 2)}, {d['one']('-beta.', '-rc.', '.dev')}, {d['digits'](1, 3)}, {d['one']('', '.tar.gz', '-py3-none-any.whl')})")
    kind("memory address", 0, plain, lambda d: f"concat('0x', {d['hexed'](14, 16)})")
    kind("rule", 0, bare, lambda d: f"repeat({d['one']('-', '=', '_', '.', '~', '-=', '+-')}, 16 + cast(pmod(id, 30) as int))")
    return out


def reviewed(spark: SparkSession, dictionary: DataFrame, each: int = 60) -> DataFrame:
    """doc_id, text, source and label: ``each`` examples of every reviewed kind, amid words of the dictionary. The same for the same dictionary."""
    frequent = [r.word for r in dictionary.orderBy(F.desc("n"), "word").limit(300).collect()]
    words = F.from_json(F.lit(json.dumps(sorted({*frequent, *COMMON_WORDS}))), "array<string>")  # of ``with_common``, so all are in the dictionary
    kinds, some, frames = [*enumerate(reviewed_kinds())], 6, []
    for k in range(0, len(kinds), some):  # a few kinds at a time, as the code that Spark makes of an expression has a limit
        rows = spark.range(each * k, each * min(k + some, len(kinds)), 1, 1).select((F.col("id") / each).cast("int").alias("kind"), "id", words.alias("words"))
        value, labels = F.lit(None).cast("string"), F.lit(None).cast("int")
        for i, (_, label, options, sql) in kinds[k : k + some]:
            here = F.col("kind") == i
            value, labels = F.when(here, F.expr(f"concat({_of(*options)(f'before {i}')}, {sql})")).otherwise(value), F.when(here, label).otherwise(labels)
        frames.append(rows.select("id", "words", value.alias("value"), labels.alias("label")))
    rows = reduce(DataFrame.unionByName, frames)
    word = lambda k: F.expr(f"element_at(words, cast(pmod(xxhash64(id, 'around {k}'), size(words)) as int) + 1)")
    after = F.expr(_of(" ", "\" ", "' ", "\n", ", ", ". ", ") ")("after"))
    text = F.concat(F.concat_ws(" ", *(word(k) for k in range(4))), F.lit(" "), F.col("value"), after, F.concat_ws(" ", *(word(k) for k in range(4, 8))))
    return rows.select("id", text.alias("text"), F.expr(_of("src", "lib", "web", "docs", "test", "example")("path")).alias("source"), "label").withColumnRenamed("id", "doc_id")


def labelled_base(spark: SparkSession, dictionary: DataFrame) -> DataFrame:
    """Candidates of the reviewed examples, with their labels."""
    docs = cut(reviewed(spark, dictionary))
    return candidates(docs).join(docs.select("doc_id", "label"), "doc_id")


def word_odds(labelled: DataFrame, words: int = 5_000, least: int = 20) -> DataFrame:
    """word and odds: how much oftener the word comes before a secret than before another candidate (log2, one added to each).

    Only of words that stand before ``least`` labelled findings: the odds of rarer ones would give away the labels of the few that they come from.
    """
    counts = labelled.groupBy(last_word().alias("word")).agg(F.sum("label").alias("yes"), F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("word") != ""))
    return counts.orderBy(F.desc("n"), "word").limit(words).select("word", F.log2((F.col("yes") + 1) / (F.col("n") - F.col("yes") + 1)).alias("odds"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", threshold: float = 0.5, per_class: int = 5_000, words: int = 30_000, trees: int = 40, depth: int = 10) -> DataFrame:
    """The findings: doc_id, key, start, stop, value and score of each candidate that the forest calls a secret.

    The forest always learns from the reviewed examples. labelled: rows of ``candidates`` with label 0 or 1, which it learns
    from besides; by default the corpus's harmless findings (``weak_labels``) of documents that are not held out.
    """
    found = cut(candidates(docs, path))
    dictionary = cut(with_common(corpus_words(docs, words)))
    if labelled is None:
        labelled = weak_labels(found.where(~F.coalesce(held_out(), F.lit(True))))
    own = [*found.columns, "label"]
    given = sample(labelled.select(own), "label", per_class, "key", "start")
    known = cut(labelled_base(docs.sparkSession, dictionary).select(own).unionByName(given))
    table, odds = letter_table(dictionary), cut(word_odds(known))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows = featured(known, dictionary, table, odds).select("key", "start", F.col("label").cast("double"), *FEATURES)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=7)
    # The forest draws rows by their place, so they get one that does not depend on tasks; keys are hashes, which spread equal features.
    model = forest.fit(assembler.transform(cut(rows.orderBy("key", "start", "label"))))
    judged = model.transform(assembler.transform(featured(found, dictionary, table, odds)))
    scored = judged.select("doc_id", "key", "start", "stop", "value", vector_to_array("probability")[1].alias("score"))
    return scored.where(F.col("score") >= threshold)


def redact(docs: DataFrame, findings: DataFrame, mask: str = MASK) -> DataFrame:
    """The documents with the spans of the findings masked in their texts.

    Only documents with findings have spans to join; the fold over them takes each span once, from the left.
    """
    key, own_id, own_key, spans = free(docs, "key", "span_id", "span_key", "spans")
    listed = findings.select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), F.struct("start", "stop").alias("span")).distinct().groupBy(own_id, own_key).agg(F.array_sort(F.collect_list("span")).alias(spans))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text").cast("string")))
    joined = keyed.join(listed, (F.col(key) == F.col(own_key)) & F.col("doc_id").eqNullSafe(F.col(own_id)), "left")
    before = F.transform(spans, lambda s, i: F.struct(F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["stop"]).alias("a"), s["start"].alias("b")))
    kept = F.transform(before, lambda x: F.substring(F.col("text"), x["a"] + 1, x["b"] - x["a"]))
    last = F.substring(F.col("text"), F.element_at(spans, -1)["stop"] + 1, F.length("text"))
    return joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, mask), F.lit(mask), last))).select(*docs.columns)
