"""Secret scanning with a random forest that removes false positives; DataFrame, SQL and Spark ML functions only.

Candidates are words that look like keys (`least_length` characters of the usual alphabets) and values assigned to a
name such as token or password. A word of several parts, as in JSON or a query string, gives each of its parts with the parts before it as context. Each gets features of its length, its character transitions, how much of it a dictionary covers,
the path-like parts of it and of the document's source, and the words around it. A random forest fitted on labelled findings says which are secrets.
No shuffle is needed to find and judge them: the words around a candidate come from its own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import kept_table, small_side

MASKED = "<SECRET>"
#: Words of which placeholders, file names and prose are made.
DICTIONARY = (
    "access", "account", "admin", "and", "build", "change", "chapter", "client", "com", "config", "data", "default", "demo", "dummy",
    "example", "file", "final", "for", "foo", "here", "html", "http", "image", "index", "insert", "key", "license", "local",
    "mail", "me", "my", "name", "net", "number", "order", "org", "page", "part", "pass", "password", "placeholder", "report", "sample", "secret",
    "section", "server", "test", "the", "token", "user", "value", "version", "with", "word", "www", "xxx", "your")
NAMES = r"(token|secret|passw|passphrase|pwd|api.?key|access.?key|auth|bearer|credential|private.?key)"
OTHER = r"(commit|sha-?[0-9]*|md5|checksum|hash|uuid|guid|version|build|digest|etag|revision|isbn|order|invoice|call|phone|mail|from|page|see)"
PLACEHOLDER = r"(example|sample|dummy|placeholder|your|change.?me|xxx|test|demo|insert)"


#: How keys of well-known issuers begin.
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|ghs_|ghu_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox[abprs]-|AIza|npm_|hf_|SG\\.)"
#: What parts the inside of a word: quotes, brackets, and the separators of query strings and lists.
INNER = "[\"\\'`(){}<>\\\\[\\\\],;&?|]+"


@dataclass(frozen=True)
class Scan:
    least_length: int = 16
    least_assigned: int = 8
    threshold: float = 0.5
    trees: int = 30
    depth: int = 8
    seed: int = 17
    #: Findings that the forest is fitted on, at most.
    fitted_on: int = 50_000


FEATURES = ("length", "digits", "uppers", "symbols", "transitions", "distinct", "vowels", "longest_letters", "hex", "covered",
            "slashes", "dots", "at_sign", "test_path", "named", "assigned", "other_name", "placeholder", "issued")


def candidates(docs: DataFrame, scan: Scan = Scan(), more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `more` columns of docs, source, place (word number from 0), token, before (three words, and what stands before it in its own word) and
    after (one word). A word may hold several candidates, all with its place."""
    gap = r"'[\\x20\\x09-\\x0D]+'"
    parts = f"filter(split(words[i], '{INNER}'), p -> p <> '')"
    looks = f"'^[^A-Za-z0-9]*([A-Za-z_][A-Za-z0-9_.-]*[=:])?[^A-Za-z0-9]*[A-Za-z0-9+/_=.@:-]{{{scan.least_length},}}[^A-Za-z0-9]*$'"
    named = f"'(?i){NAMES}'"
    said_before = f"(i > 0 AND words[i - 1] RLIKE '[=:]$' AND concat_ws(' ', words[greatest(i - 2, 0)], words[i - 1]) RLIKE {named})"
    # The test for length comes first: few words are long.
    whole = f"""
      (char_length(words[i]) >= {scan.least_length} AND words[i] RLIKE {looks})
      OR (char_length(words[i]) >= {scan.least_assigned} AND {said_before})
      OR (char_length(words[i]) >= {scan.least_assigned} + 4 AND words[i] RLIKE '[=:]' AND words[i] RLIKE '(?i){NAMES}[^=:]*[=:][^=:]{{{scan.least_assigned},}}')"""
    several = f"char_length(words[i]) >= {scan.least_assigned} + 4 AND words[i] RLIKE '[A-Za-z0-9]{INNER}[^A-Za-z0-9]*[A-Za-z0-9]'"
    cells = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("text <> ''")
    # The lambda parameter names the words once; a column would be split anew for every element. A value with a name before it is one secret, whatever it holds.
    found = cells.selectExpr("doc_id", *more, "source", f"""
      transform(array(split(text, {gap})), words -> transform(filter(sequence(0, size(words) - 1), i -> ({whole}) OR ({several})), i -> named_struct(
        'place', i, 'parts', if(({several}) AND NOT {said_before}, {parts}, array(words[i])),
        'before', concat_ws(' ', slice(words, greatest(i - 2, 1), least(i, 3))), 'after', coalesce(get(words, i + 1), ''))))[0] AS found""")
    one = found.selectExpr("doc_id", *more, "source", "explode(found) AS f").selectExpr("doc_id", *more, "source", "f.*")
    # Of a word of one part the tests above hold; parts of others are tested here, with up to four parts before them as context.
    inner = one.selectExpr("doc_id", *more, "source", "place", "before", "after", "size(parts) > 1 AS is_part", "parts", "posexplode(parts) AS (k, word)").selectExpr(
        "doc_id", *more, "source", "place", "after", "word", "is_part", "concat_ws(' ', before, array_join(slice(parts, greatest(k - 3, 1), least(k, 4)), ' ')) AS before")
    part_wanted = f"""(char_length(word) >= {scan.least_length} AND word RLIKE {looks})
      OR (char_length(word) >= {scan.least_assigned} AND before RLIKE '[=:]$' AND substring_index(before, ' ', -3) RLIKE {named})
      OR (char_length(word) >= {scan.least_assigned} + 4 AND word RLIKE '(?i){NAMES}[^=:]*[=:][^=:]{{{scan.least_assigned},}}')"""
    # name=value in one word: the name joins the words before. Then quotes and punctuation around the value go.
    inline = r"'^[^A-Za-z0-9]*([A-Za-z_][A-Za-z0-9_.-]*[=:])'"
    return inner.where(f"NOT is_part OR {part_wanted}").selectExpr(
        "doc_id", *more, "source", "place", f"concat_ws(' ', before, regexp_extract(word, {inline}, 1)) AS before", "after",
        f"regexp_replace(regexp_replace(word, {inline}, ''), '^[^A-Za-z0-9+/_]+|[^A-Za-z0-9+/_=]+$', '') AS token",
    ).filter("token <> ''")


def features(found: DataFrame) -> DataFrame:
    """The findings with the columns FEATURES, all doubles."""
    words = "|".join(DICTIONARY)
    near = "concat_ws(' ', before, after)"
    share = lambda pattern: f"regexp_count(token, '{pattern}') / char_length(token)"
    expressions = {
        "length": "least(char_length(token), 1000)",
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "transitions": share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"),
        "distinct": "size(array_distinct(split(token, ''))) / sqrt(char_length(token))",
        "vowels": "regexp_count(token, '[aeiouAEIOU]') / greatest(regexp_count(token, '[A-Za-z]'), 1)",
        "longest_letters": "array_max(transform(split(token, '[^A-Za-z]+'), x -> char_length(x)))",
        "hex": "if(token RLIKE '^[0-9a-fA-F]+$', 1, 0)",
        "covered": f"1 - char_length(regexp_replace(lower(token), '{words}', '')) / char_length(token)",
        "slashes": share("[/]"),
        "dots": share("[.]"),
        "at_sign": "if(contains(token, '@') OR contains(token, '://'), 1, 0)",
        "test_path": "if(lower(source) RLIKE '(test|example|sample|fixture|mock|doc/|docs/)', 1, 0)",
        "named": f"if(before RLIKE '(?i){NAMES}', 1, 0)",
        "assigned": "if(before RLIKE '[=:][ \"]*$', 1, 0)",
        "other_name": f"if({near} RLIKE '(?i)\\\\b{OTHER}\\\\b', 1, 0)",
        "placeholder": f"if(token RLIKE '(?i){PLACEHOLDER}', 1, 0)",
        "issued": f"if(token RLIKE '{ISSUED}', 1, 0)",
    }
    return found.selectExpr("*", *[f"cast({expressions[f]} AS double) AS {f}" for f in FEATURES])


def example_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled findings to fit on where there are none of one's own: doc_id, text, source, label.

    Keys of usual forms after a name count as secrets, in JSON and query strings as well, and keys of well-known issuers wherever they stand; other
    forms after words like commit or checksum, and addresses, numbers, links, file names, long words and placeholders count as none,
    whatever stands before them.
    """
    made = spark.range(n).selectExpr("id AS doc_id", "sha2(cast(concat('finding', id) AS binary), 512) AS r", "pmod(xxhash64(id), 997) AS x").selectExpr(
        "*", "regexp_replace(base64(unhex(r)), '[^A-Za-z0-9]', '') AS b")
    keys = ("substr(r, 1, 40)", "substr(r, 1, 32)", "substr(b, 1, 40)", "substr(b, 1, 24)", "concat('AKIA', upper(substr(b, 1, 16)))",
            "concat('ghp_', substr(b, 1, 36))", "upper(substr(r, 1, 40))", "concat('sk_live_', substr(b, 1, 24))", "substr(r, 1, 64)", "concat(substr(b, 1, 9), '!', substr(b, 10, 5), '7')")
    plain = ("concat(substr(r, 1, 8), '-', substr(r, 9, 4), '-', substr(r, 13, 4), '-', substr(r, 17, 4), '-', substr(r, 21, 12))",
             "concat('reader.', x, '@mail', x % 9, '.example.com')", "concat('+1555', x, x, '0123456')", "concat('192.168.', x % 250, '.', x % 199, ':8080/a')",
             "concat('2024-05-', 10 + x % 18, 'T10:', 10 + x % 49, ':00Z')", "concat('https://www.example.org/page/', x, '/index.html')",
             "concat('chapter', x, 'section', x % 9, 'part')", "concat('report_', x, '_final_version.pdf')", "concat('000', x, x, x, x, x, '00')", "concat('version-', x, '.12.7-build', x)")
    issued = keys[4:6] + (keys[7],)
    unnamed = tuple(k for k in keys if k not in issued)
    wordy = ("'internationalisation'", "'counterrevolutionaries'", "'state-of-the-art-machines'", "'readUserAccountBalance'", "'the/northern/river/bank'",
             "'max_connection_timeout'", "concat('Item-', x, ':northern-provinces')", "'well-known:long-standing'", "'_________________'", "'aaaaaaaaaaaaaaaaaaaa'")
    held = ("concat('your_token_here_', x)", "concat('changeme_example', x)", "'xxxxxxxxxxxxxxxx1'", "concat('insert-your-key-here-', x % 9)", "concat('dummy_test_password', x)")
    names = ("token =", "api_key:", "password =", "secret =", "Authorization: Bearer", "access_key =", "auth_token :", "the private key", "client_secret=", "API TOKEN =")
    others = ("commit", "sha256", "checksum:", "md5 of", "build =", "uuid:", "see", "the digest =", "of the", "revision")

    around = ("", "the ", "we found ", "export ", "then he said ", "commit ", "it is: ", "use ")

    def pick(options: tuple[str, ...], by: str, literal: bool = False) -> str:
        # One node for each option; as cases, each would repeat the test, and all of that is planned on the driver.
        return f"elt(cast(pmod({by}, {len(options)}) AS int) + 1, {', '.join(repr(o) if literal else o for o in options)})"

    inside = ("concat('{\"api_key\":\"', {key}, '\",\"n\":', x, '}')", "concat('https://www.example.org/get?token=', {key}, '&page=', x)",
              "concat('{\"user\":\"reader\",\"password\":\"', {key}, '\"}')", "concat('curl?access_token=', {key})")
    outside = ("concat('{\"checksum\":\"', {key}, '\",\"n\":', x, '}')", "concat('https://www.example.org/get?commit=', {key}, '&page=', x)",
               "concat('https://www.example.org/northern-provinces/', x, '?page=', x)", "concat('{\"title\":\"counterrevolutionaries\",\"id\":', x, '}')")
    quote = "CASE WHEN x % 3 = 0 THEN '\"' ELSE '' END"
    forms = made.selectExpr(
        "doc_id", "r", "x", "CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS double) AS label",
        f"""CASE WHEN doc_id % 8 IN (0, 4) THEN concat({pick(names, 'x', True)}, ' ', {quote}, {pick(keys, 'doc_id div 4')}, {quote})
             WHEN doc_id % 8 = 2 THEN concat({pick(around, 'x', True)}, {quote}, {pick(issued, 'doc_id div 8')}, {quote})
             WHEN doc_id % 8 = 6 THEN {pick(tuple(t.replace("{key}", f"({pick(keys[:9], 'doc_id div 8')})") for t in inside), 'x')}
             WHEN doc_id % 8 = 1 THEN concat({pick(others, 'x', True)}, ' ', {quote}, {pick(unnamed, 'doc_id div 8')}, {quote})
             WHEN doc_id % 16 = 3 THEN concat({pick(names, 'x', True)}, ' ', {quote}, {pick(held, 'doc_id div 16')}, {quote})
             WHEN doc_id % 16 = 11 THEN {pick(tuple(t.replace("{key}", f"({pick(unnamed, 'doc_id div 16')})") for t in outside), 'x')}
             WHEN doc_id % 16 = 5 THEN concat({pick(names, 'x', True)}, ' ', {pick(plain[1:6], 'doc_id div 16')})
             WHEN doc_id % 16 = 13 THEN concat({pick(around, 'x', True)}, {pick(wordy, 'doc_id div 16')})
             ELSE concat({pick(others, 'x', True)}, ' ', {pick(plain, 'doc_id div 8')}) END AS said""")
    return forms.selectExpr("doc_id", "concat('of it and ', said, ' is on the') AS text", "CASE WHEN x % 5 = 0 THEN concat('src', x) ELSE 'notes' END AS source", "label")


def _assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(found))


def fit(labelled: DataFrame, scan: Scan = Scan()) -> RandomForestClassificationModel:
    """A forest from labelled texts (doc_id, text, source, label 0 or 1); a text's label holds for its longest finding."""
    # Written first: what makes the texts would else be put into every expression that reads them, in code too large to compile, on the driver.
    labelled = kept_table(labelled.select("doc_id", "text", "source", F.col("label").cast("double").alias("label")), "labelled")
    found = candidates(labelled, scan)
    longest = found.groupBy("doc_id").agg(F.max_by(F.struct("source", "place", "token", "before", "after"), F.struct(F.char_length("token"), "place")).alias("f"))
    rows = longest.select("doc_id", "f.*").join(labelled.select("doc_id", "label"), "doc_id").filter("label IS NOT NULL")
    # Written once: the forest reads its rows several times, and each reading would plan and compile the search for candidates anew.
    rows = kept_table(features(rows.orderBy(F.xxhash64("doc_id")).limit(scan.fitted_on)).select(*FEATURES, "label"), "findings")
    forest = RandomForestClassifier(numTrees=scan.trees, maxDepth=scan.depth, seed=scan.seed, featureSubsetStrategy="sqrt", minInstancesPerNode=2)
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("features", "label"))


def scan_documents(docs: DataFrame, model: RandomForestClassificationModel, scan: Scan = Scan(), more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, place, token, before, after, score and is_secret of every candidate in the whole texts.

    Null and empty texts have none; texts of any length are read whole; a null source is the empty path; a null doc_id stays null; rows and
    candidates that repeat are judged each; a score equal to the threshold is a secret. Further columns are left out but those of
    `more`; an empty table gives no rows.
    """
    judged = model.transform(_assembled(candidates(docs, scan, more)))
    score = F.round(vector_to_array("probability")[1], 6)
    return judged.select("doc_id", *more, "place", "token", "before", "after", score.alias("score"), (score >= scan.threshold).alias("is_secret"))


def masked_documents(docs: DataFrame, model: RandomForestClassificationModel, scan: Scan = Scan()) -> DataFrame:
    """All rows of docs with the same columns; each secret in a text is replaced by MASKED, and n_chars follows where it is a column.

    Texts without any stay as they are. Rows with one doc_id, or with none, are masked each by its own text; equal texts are masked alike.
    """
    digest = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    keyed = docs.select("doc_id", "source", "text", digest.alias("_text_digest"))
    # Written once: counting the texts with secrets and joining them would search all texts twice.
    secrets = kept_table(scan_documents(keyed, model, scan, ("_text_digest",)).filter("is_secret").groupBy("_text_digest").agg(
        F.array_sort(F.collect_set("token")).alias("found")), "secrets")
    # The longest first, so that a secret that holds another goes whole.
    ordered = small_side(secrets.selectExpr("_text_digest AS of_text", "array_sort(found, (a, b) -> char_length(b) - char_length(a)) AS found"))
    joined = docs.join(ordered, F.sha2(docs["text"].cast("string").cast("binary"), 256) == ordered["of_text"], "left")
    none = ordered["found"].isNull()
    masked = F.aggregate(ordered["found"], docs["text"].cast("string"), lambda t, s: F.replace(t, s, F.lit(MASKED)))
    text: Column = F.when(none, docs["text"]).otherwise(masked)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(text.alias("text"))
        elif name == "n_chars":
            columns.append(F.when(none, docs[name]).otherwise(F.char_length(text)).cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(docs[f"`{name}`"])
    return joined.select(*columns)


def findings(found: DataFrame) -> DataFrame:
    """What may be shown of findings: where they are, their length and fingerprint, and the verdict."""
    return found.select("doc_id", F.col("place").cast("long").alias("place"), F.char_length("token").cast("long").alias("length"),
                        F.sha2(F.col("token").cast("binary"), 256).alias("token_sha256"), "score", "is_secret")
