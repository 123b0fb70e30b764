"""Secret scan: candidate strings, then a random forest that removes false positives.

Candidates are values of four characters or more after secret words (assigned by ``=``, ``:``, ``=>`` and the like, over
blanks and line breaks, or after blanks alone as on a command line; quoted ones up to their quote), values of eight or
more after any ``=`` or ``:``, and runs of 20 or more key characters with a digit. The forest looks at a
candidate's length, its character classes and transitions, how much of it dictionary words cover, signs of paths,
URLs and placeholders, and the words next to it. It is trained from labelled findings (text, label), by default
``labelled_findings``, at most ``most_labels`` of them, and compiled into one column expression. A document is judged
inside its row: no shuffle, no join, and a text with very many candidates stays one row.

Null and empty texts have no candidates. U+0001 marks the cuts, so a U+0001 of the text counts as a blank. Repeated rows
and null ``doc_id`` are kept; other columns pass through ``redacted`` unchanged, whatever their names (names that begin
with ``_secret`` are used inside); an empty table gives no rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import smallest_hashes
from .trees import forest, tree_sql

KEY = r"A-Za-z0-9_+/=\-"
MARK = "\x01"
REMOVED = "[SECRET]"
CONTEXT = 60
#: Words that speak for or against a secret, and words of ordinary names and paths.
SECRET_WORDS = "token|secret|passw|pwd|passphrase|api.?key|access.?key|private.?key|auth|bearer|credential|signature"
NAME = rf"(?i:{SECRET_WORDS})[\w\-]{{0,100}}+[\x22\x27\x60\])]{{0,2}}+"
ASSIGNED = r"\s*+(?:=>|:=|->|={1,3}|[:>])\s*+(?:(?i:bearer|basic|digest|token|apikey)\s++)?+"
#: Blanks alone, unless the next word is a name itself.
BLANKS = rf"\s++(?![\w\-]*+[\x22\x27\x60]?\s*+[:=]|(?i:{SECRET_WORDS})[A-Za-z_\-]*+\s)"
#: Up to a blank or quote, the next name of a list or a closing tag, without punctuation at the end.
STOPS = r"\s\x22\x27\x60"
POINTS = r",;.:)\]}&<"
BARE = rf"(?=[^{STOPS}]{{4}})(?:[^{STOPS}{POINTS}]++|(?!</|[;,&]\w++=)[{POINTS}]++(?=[^{STOPS}{POINTS}]))++"
CANDIDATE = (
    rf"({NAME}(?:{ASSIGNED}|{BLANKS}))"
    rf"(?:(\x22)([^\x22\r\n]{{4,}}+)(?=\x22)|(\x27)([^\x27\r\n]{{4,}}+)(?=\x27)|([\x22\x27\x60]?+)({BARE}))"
    r"|((?<=[:=][ \t]{0,2}[\x22\x27\x60]{0,1})[^\s\x22\x27\x60<>,;:=]{8,}"
    rf"|(?<![{KEY}])(?=[A-Za-z_+/=\-]*+[0-9])[{KEY}]{{20,}}+)"
)
MARKED = "$1$2$4$6\x01$3$5$7$8\x01"
HASH_WORDS = "commit|revision|sha|md5|checksum|digest|hash|etag|build|image|layer|integrity"
ID_WORDS = "uuid|guid|\\bid\\b|order|invoice|phone|card|version|session name|file|path|url|link|page|class"
PLACEHOLDERS = "example|sample|dummy|your|change.?me|placeholder|xxxx|test|todo|none|null|redacted|default|insert|here"
DICTIONARY = (
    "access|account|action|admin|api|app|array|auth|base|bin|block|build|button|byte|cache|call|check|class|client|"
    "code|color|common|config|connect|content|context|control|core|count|create|data|date|default|default|device|"
    "document|download|element|error|event|example|factory|field|file|filter|find|first|font|form|format|from|"
    "function|get|group|handle|handler|header|height|home|host|icon|image|import|index|info|init|input|install|item|"
    "key|label|language|last|lib|library|line|link|list|load|local|log|login|main|manager|map|message|method|model|"
    "module|name|network|new|node|null|number|object|option|order|output|package|page|parse|password|path|plugin|"
    "point|print|process|project|property|public|query|read|record|report|request|response|result|return|route|"
    "save|schema|script|search|section|secret|select|send|server|service|session|set|setting|share|size|source|"
    "start|state|static|status|store|stream|string|style|system|table|target|task|template|test|text|this|time|"
    "title|token|type|update|upload|user|util|value|version|video|view|web|width|window|word|work|write|your|zone"
)
FEATURES = {
    "length": "length(v)",
    "digits": "length(regexp_replace(v, '[^0-9]', '')) / length(v)",
    "uppers": "length(regexp_replace(v, '[^A-Z]', '')) / length(v)",
    "lowers": "length(regexp_replace(v, '[^a-z]', '')) / length(v)",
    "others": "length(regexp_replace(v, '[A-Za-z0-9]', '')) / length(v)",
    "turns": "(length(regexp_replace(v, '(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])', '.'))"
             " - length(v)) / length(v)",
    "spoken": "(length(regexp_replace(lower(v), '(?<=[aeiouy])(?=[b-df-hj-np-tv-xz])', '.')) - length(v)) / length(v)",
    "hexes": "length(regexp_replace(v, '[^0-9A-Fa-f]', '')) / length(v)",
    "distinct": "size(array_distinct(split(v, ''))) / length(v)",
    "dictionary": f"1 - length(regexp_replace(lower(v), '{DICTIONARY}', '')) / length(v)",
    "slashes": "length(v) - length(regexp_replace(v, '[/.]', ''))",
    "uuid": "CASE WHEN lower(v) RLIKE '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$' THEN 1 ELSE 0 END",
    "placeholder": f"CASE WHEN lower(v) RLIKE '{PLACEHOLDERS}' THEN 1 ELSE 0 END",
    "secret_near": f"CASE WHEN lower(b) RLIKE r'(?:{SECRET_WORDS})[a-z_]*\\W{{0,6}}(?:(?:basic|bearer) )?$' THEN 1 ELSE 0 END",
    "secret_left": f"CASE WHEN lower(b) RLIKE r'{SECRET_WORDS}' THEN 1 ELSE 0 END",
    "hash_left": f"CASE WHEN lower(b) RLIKE r'(?:{HASH_WORDS})\\W+\\w*\\W*$' THEN 1 ELSE 0 END",
    "id_left": f"CASE WHEN lower(b) RLIKE r'(?:{ID_WORDS})\\W*$' THEN 1 ELSE 0 END",
    "assigned": r"CASE WHEN b RLIKE r'(?:[:=]|=>)\s*[\x22\x27]?$' THEN 1 ELSE 0 END",
    "quoted": r"CASE WHEN b RLIKE r'[\x22\x27]$' AND a RLIKE r'^[\x22\x27]' THEN 1 ELSE 0 END",
    "option": r"CASE WHEN b RLIKE r'(?:^|\s)--?[\w\-]+[ =]+[\x22\x27]?$' THEN 1 ELSE 0 END",
    "scheme": r"CASE WHEN lower(b) RLIKE r'(?:basic|bearer)\s+$' THEN 1 ELSE 0 END",
    "prefixed": "CASE WHEN v RLIKE '^(ghp_|gho_|glpat-|xox[abp]-|sk_live_|sk-|AKIA|AIza|eyJ)' THEN 1 ELSE 0 END",
}


def _scan(docs: DataFrame) -> DataFrame:
    """Adds ``_secret_parts``: the text cut at its candidates, which have the odd places, and ``_secret_found``: per
    candidate its value and the text on both sides."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK, " ")
    marked = F.regexp_replace(text, CANDIDATE, MARKED)
    cut = docs.withColumn("_secret_parts", F.split(marked, MARK))
    found = (
        "CASE WHEN size(_secret_parts) > 1 THEN transform(sequence(1, size(_secret_parts) - 2, 2), i -> struct("
        f"_secret_parts[i] AS v, right(_secret_parts[i - 1], {CONTEXT}) AS b, left(_secret_parts[i + 1], {CONTEXT}) AS a))"
        " ELSE CAST(array() AS array<struct<v: string, b: string, a: string>>) END"
    )
    return cut.withColumn("_secret_found", F.expr(found))


def _feature_structs(found: str) -> str:
    fields = ", ".join(
        f"CAST({sql.replace('(v', '(f.v').replace('lower(b', 'lower(f.b').replace('WHEN b ', 'WHEN f.b ').replace('AND a ', 'AND f.a ').replace('WHEN v ', 'WHEN f.v ')} AS DOUBLE) AS {name}"
        for name, sql in FEATURES.items()
    )
    return f"transform({found}, f -> struct({fields}))"


def labelled_findings(spark: SparkSession, n: int = 2000) -> DataFrame:
    """Labelled findings (text, label): sentences with one candidate each, half secrets and half look-alikes, with
    values and neighbouring words that follow from the row number."""
    hexes, mixed = "sha2(CAST(id AS STRING), 256)", "translate(base64(unhex(sha2(CAST(id + 7 AS STRING), 512))), '=\\n', '')"
    spoken = "concat(translate(left(md5(CAST(id AS STRING)), 7), '0123456789', 'aeiouaeiou'), 'ner')"
    left = "concat(translate(left(md5(CAST(id + 1 AS STRING)), 6), '0123456789', 'aeioulnrst'), ' ', translate(left(md5(CAST(id + 2 AS STRING)), 5), '0123456789', 'aeioulnrst'))"
    key = "element_at(array('token', 'secret', 'password', 'api_key', 'apiKey', 'access_key', 'auth_token', 'client_secret', 'TOKEN', 'DB_PASSWORD', 'private-key', 'passphrase'), 1 + CAST(pmod(hash(id), 12) AS INT))"
    sign = "element_at(array(' = \"', ': \"', '=', ': ', ' = '), 1 + CAST(pmod(hash(id, 1), 5) AS INT))"
    plain = "element_at(array('name', 'title', 'result', 'see', 'value', 'note', 'path', 'source'), 1 + CAST(pmod(hash(id, 2), 8) AS INT))"
    size = "CAST(pmod(hash(id, 3), 30) AS INT)"
    uuid = f"concat_ws('-', substr({hexes}, 1, 8), substr({hexes}, 9, 4), substr({hexes}, 13, 4), substr({hexes}, 17, 4), substr({hexes}, 21, 12))"
    secrets = [
        f"concat({key}, {sign}, left({hexes}, 24 + {size}), '\"')",
        f"concat({key}, {sign}, upper(left({hexes}, 32 + {size} % 9)), '\"')",
        f"concat({key}, {sign}, left({mixed}, 16 + {size}))",
        f"concat('Authorization: Bearer ', left({mixed}, 40 + {size}))",
        f"concat(element_at(array('ghp_', 'glpat-', 'sk_live_', 'AKIA', 'eyJ'), 1 + {size} % 5), left(translate({mixed}, '+/', 'ab'), 30))",
        f"concat({key}, {sign}, left({mixed}, 9 + {size} % 6), '!')",
        f"concat('run --', {key}, ' ', left({mixed}, 9 + {size} % 16))",
        f"concat({key}, ' => ''', left({mixed}, 9 + {size} % 6), '!''')",
        f"concat('\"', {key}, '\":', element_at(array('   ', '\n  ', '\t\t'), 1 + {size} % 3), '\"', left({mixed}, 9 + {size} % 9), '\"')",
        f"concat('Authorization: Basic ', left({mixed}, 12 + {size}))",
        f"concat(element_at(array('Bearer ', 'Authorization: Bearer '), 1 + {size} % 2), translate(left({mixed}, 24 + {size}), '0123456789+/', 'gkzqXvWJbPhd'))",
        f"concat({key}, {sign}, left({mixed}, 2), ',', substr({mixed}, 3, 2), ':', substr({mixed}, 5, 6 + {size} % 6))",
    ]
    others = [
        f"concat(element_at(array('commit ', 'revision ', 'sha256: ', 'md5: ', 'checksum = ', 'digest: '), 1 + {size} % 6), left({hexes}, 32 + {size}))",
        f"concat(element_at(array('id = \"', 'uuid: ', 'request id ', 'guid='), 1 + {size} % 4), {uuid})",
        f"concat({plain}, ': /usr/lib/', {spoken}, '/config/user_', {spoken}, '2/list.', {size})",
        f"concat({key}, {sign}, element_at(array('your_token_here', 'changeme123', 'xxxxxxxxxxxxxxxx', 'example-password', '<insert-here>', 'default_value'), 1 + {size} % 6), '\"')",
        f"concat({plain}, ': https://www.', {spoken}, '.com/view/page', {size}, '/index.html')",
        f"concat({plain}, {sign}, 'getUser', initcap({spoken}), 'Request', {size}, 'HandlerFactory')",
        f"concat(element_at(array('order: ', 'phone = ', 'card: ', 'version: '), 1 + {size} % 4), CAST(abs(xxhash64(id)) AS STRING), '{'0' * 3}')",
        f"concat({plain}, ': ', {spoken}, {spoken})",
        f"concat({key}, ': ', {spoken}, {spoken}, '.')",
        f"concat({key}, ' ', {spoken})",
        f"concat('the ', {key}, ' ', element_at(array('needed', 'must match', 'expires soon', 'reset page', 'holder', 'which is new'), 1 + {size} % 6))",
        f"concat({key}, ' => ''', {spoken}, '''')",
        f"concat('\"', {key}, '\":   \"', element_at(array('your token', 'changeme123', 'none', 'example-password', 'insert here'), 1 + {size} % 5), '\"')",
        f"concat('bearer of ', {spoken}, element_at(array(', author ', ', authority: ', ' --author '), 1 + {size} % 3), initcap({spoken}))",
        f"concat({plain}, ' ', {spoken}, '-', {spoken}, '-', {spoken}, '-', {size})",
    ]
    kinds = [
        " ".join(f"WHEN pmod(hash(id, 5), {len(k)}) = {i} THEN {sql}" for i, sql in enumerate(k)) for k in (secrets, others)
    ]
    text = f"concat({left}, ' ', CASE id % 2 WHEN 1 THEN CASE {kinds[0]} END ELSE CASE {kinds[1]} END END, ' ', {spoken})"
    return spark.range(n).selectExpr(f"{text} AS text", "CAST(id % 2 AS INT) AS label")


def train(labelled: DataFrame, trees: int = 30, depth: int = 7, most_labels: int = 5000) -> list:
    """A forest from labelled findings (text, label): of these the ``most_labels`` with the smallest hash."""
    rows = (
        _scan(labelled.filter("text IS NOT NULL AND label IS NOT NULL")).select("text", "label", F.expr(_feature_structs("_secret_found")).alias("f"))
        .select("text", "label", F.explode("f").alias("f")).select("text", "label", "f.*")
    )
    rows = smallest_hashes(rows, "text", most_labels, *FEATURES, "label").drop("text").collect()
    if not rows:
        return [(0.5,)]
    x = np.array([[r[name] for name in FEATURES] for r in rows], float)
    return forest(x, np.array([r["label"] for r in rows], float), trees, depth, np.random.default_rng(1))


def _scored(docs: DataFrame, model: list) -> DataFrame:
    """Adds ``_secret_odds``: the forest's probability of every candidate."""
    names = [f"f.{name}" for name in FEATURES]
    votes = " + ".join(tree_sql(tree, names) for tree in model)
    shaped = _scan(docs).withColumn("_secret_shape", F.expr(_feature_structs("_secret_found")))
    return shaped.withColumn("_secret_odds", F.expr(f"transform(_secret_shape, f -> ({votes}) / {len(model)})"))


def findings(docs: DataFrame, model: list, least: float = 0.5) -> DataFrame:
    """Every candidate of ``docs`` (doc_id, text): doc_id, start and length in characters, probability, secret, value."""
    lengths = "transform(_secret_parts, p -> length(p))"
    # Running sums by doubling: linear steps, as often as the list can be halved.
    ends = (
        f"aggregate(sequence(0, 30), {lengths}, (s, k) -> CASE WHEN size(s) > shiftleft(1, k) THEN transform(s, (x, i) -> "
        "x + CASE WHEN i >= shiftleft(1, k) THEN s[i - shiftleft(1, k)] ELSE 0 END) ELSE s END)"
    )
    some = _scored(docs.select("doc_id", "text"), model).filter("size(_secret_parts) > 1")
    rows = some.withColumn("_secret_ends", F.expr(ends)).select(
        "doc_id", F.expr("explode(transform(_secret_odds, (p, i) -> struct(_secret_ends[2 * i] AS start, "
                         "_secret_found[i].v AS value, p AS probability)))").alias("f"),
    )
    return rows.select(
        "doc_id", F.col("f.start").alias("start"), F.length("f.value").alias("length"), F.col("f.probability").alias("probability"),
        (F.col("f.probability") >= least).alias("secret"), F.col("f.value").alias("value"),
    )


def redacted(docs: DataFrame, model: list, least: float = 0.5) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``REMOVED``; other texts stay as they are."""
    kept = (
        "array_join(transform(_secret_parts, (p, i) -> CASE WHEN i % 2 = 1 THEN CASE WHEN "
        f"_secret_odds[CAST((i - 1) / 2 AS INT)] >= {least}D THEN '{REMOVED}' ELSE p END ELSE p END), '')"
    )
    hit: Column = F.exists("_secret_odds", lambda p: p >= least)
    scored = _scored(docs, model)
    return scored.withColumn("text", F.when(hit, F.expr(kept)).otherwise(F.col("text"))).select(*docs.columns)
