"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, written

#: A candidate: what is assigned to a credential's name, short or with symbols, or a long run of key characters. The
#: run is possessive, so its cost is linear; names are looked for only behind a colon or equals sign.
NAMES = r"(?i:password|passwd|pwd|passphrase|passcode|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|signing[_ -]?key|auth|credential)"
SCHEME = r"(?:(?i:bearer|basic|token)[ \t]{1,2})?"
ASSIGNED = rf"(?<=[:=>\s\"'`])(?<=[:=]>?[ \t]{{0,4}}{SCHEME}[\"'`]?)(?<={NAMES}[A-Za-z0-9_\-]{{0,24}}[\"'`]?[ \t]{{0,4}}[:=]{{1,2}}>?[ \t]{{0,4}}{SCHEME}[\"'`]?)[^\s\"'`:=][^\s\"'`]{{2,254}}[^\s\"'`,;.)\]}}>]"
CANDIDATE = rf"{ASSIGNED}|[A-Za-z0-9+/_.\-]{{16,}}+={{0,2}}+"
THRESHOLD = 0.5
CONTEXT = 40

#: Words that stand beside secrets, words that stand beside other long values, and words that names are made of.
SECRET_WORDS = ["password", "passwd", "pwd", "passphrase", "secret", "token", "api[_ -]?key", "apikey", "access[_ -]?key", "private[_ -]?key", "auth", "authorization", "bearer", "credential", "signing[_ -]?key", "client[_ -]?secret"]
OTHER_WORDS = ["sha", "sha1", "sha256", "sha512", "md5", "hash", "digest", "checksum", "integrity", "commit", "revision", "uuid", "guid", "etag", "version", "build", "example", "sample", "dummy", "order", "invoice", "isbn", "card", "phone", "file", "path", "url", "href", "src", "import", "include"]
DICTIONARY = [
    "account", "action", "address", "admin", "agent", "after", "alpha", "application", "array", "assets", "backup", "before", "beta", "branch", "button", "cache", "change", "class", "client", "cluster", "code", "color", "com", "config", "content", "control", "count", "create", "custom", "data", "date", "default", "delete", "design", "dev", "device", "document", "domain", "download", "error", "event", "example", "export", "feature", "field", "file", "filter", "font", "form", "frame", "function", "global", "group", "handler", "header", "home", "host", "html", "http", "icon", "image", "import", "index", "info", "input", "install", "item", "java", "key", "lang", "layout", "level", "lib", "link", "list", "local", "log", "login", "main", "manager", "master", "menu", "message", "method", "model", "module", "name", "network", "node", "number", "object", "option", "order", "output", "package", "page", "param", "path", "plugin", "point", "position", "price", "process", "product", "profile", "project", "property", "public", "python", "query", "read", "record", "release", "report", "request", "resource", "response", "result", "root", "schema", "script", "search", "select", "server", "service", "session", "setting", "share", "site", "size", "source", "spark", "start", "state", "static", "status", "string", "style", "system", "table", "target", "task", "template", "test", "text", "theme", "time", "title", "tool", "type", "update", "upload", "user", "value", "version", "video", "view", "web", "widget", "window", "word", "work", "www", "your",
]
#: Beginnings that issuers give their keys.
ISSUED = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk-|rk_live_|xox[abpr]-|AIza|npm_|pypi-|SG\.|hf_|dop_v1_)"

FEATURES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_symbols", "f_transitions", "f_distinct", "f_repeats", "f_hex", "f_dictionary",
    "f_path", "f_extension", "f_issued", "f_secret_word", "f_other_word", "f_assigned", "f_quoted", "f_address",
]


def _share(value: Column, kind: str) -> Column:
    return F.try_divide(F.regexp_count(value, F.lit(kind)), F.length(value))


def features(findings: DataFrame) -> DataFrame:
    """Adds the forest's features to findings (value, before, after). An empty or null value has zeros for shares; lengths count up to 128."""
    value, before = F.col("value"), F.lower("before")
    low = F.lower(value)
    last = F.rtrim(F.col("before"))
    cells = {
        "f_length": F.least(F.coalesce(F.length(value), F.lit(0)), F.lit(128)).cast("double"),
        "f_digits": _share(value, "[0-9]"),
        "f_upper": _share(value, "[A-Z]"),
        "f_lower": _share(value, "[a-z]"),
        "f_symbols": _share(value, "[^A-Za-z0-9]"),
        "f_transitions": _share(value, "(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"),
        "f_distinct": F.try_divide(F.size(F.array_distinct(F.split(value, ""))), F.length(value)),
        "f_repeats": _share(value, r"(.)\1\1"),
        "f_hex": value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "f_dictionary": 1 - F.try_divide(F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=len, reverse=True)), "")), F.length(value)),
        "f_path": F.regexp_count(value, F.lit("[/.]")).cast("double"),
        "f_extension": value.rlike(r"\.[A-Za-z][A-Za-z0-9]{1,4}$").cast("double"),
        "f_issued": value.rlike(ISSUED).cast("double"),
        "f_secret_word": before.rlike(rf"(?:{'|'.join(SECRET_WORDS)})[^A-Za-z]*$").cast("double") + before.rlike("|".join(SECRET_WORDS)).cast("double"),
        "f_other_word": before.rlike(rf"(?:^|[^a-z])(?:{'|'.join(OTHER_WORDS)})[^A-Za-z]*$").cast("double"),
        "f_assigned": F.rtrim(F.regexp_replace(last, "[\"'`]+$", "")).rlike("[=:]$").cast("double"),
        "f_quoted": last.rlike("[\"'`]$").cast("double") * F.col("after").rlike("^[\"'`]").cast("double"),
        "f_address": (before.rlike("(?:://|@|www)[^ ]*$") | F.col("after").rlike("^(?:@|://)")).cast("double"),
    }
    return findings.withColumns({name: F.coalesce(cell.cast("double"), F.lit(0.0)) for name, cell in cells.items()})


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, value, before, after): candidates with code-point offsets and what stands beside them."""
    base = id_and_text(docs, id_col, text_col)
    found = base.withColumn("runs", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("runs") > 0)
    gaps = found.withColumn("gaps", F.split("text", CANDIDATE, -1)).select("doc_id", "runs", "gaps")
    # What stands before goes on across earlier candidates: a long name is one, and it says what its value is.
    placed = F.aggregate(
        F.arrays_zip("runs", F.slice("gaps", 1, F.size("runs")).alias("gap")),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast("array<struct<start:int,before:string>>").alias("found")),
        lambda done, x: F.struct(
            (done["at"] + F.length(x["gap"]) + F.length(x["runs"])).alias("at"),
            F.right(F.concat(done["tail"], x["gap"], x["runs"]), F.lit(CONTEXT)).alias("tail"),
            F.array_append(done["found"], F.struct((done["at"] + F.length(x["gap"])).alias("start"), F.right(F.concat(done["tail"], x["gap"]), F.lit(CONTEXT)).alias("before"))).alias("found"),
        ),
        lambda done: done["found"],
    )
    rows = gaps.withColumn("found", placed).select("doc_id", "runs", "gaps", F.posexplode("found").alias("i", "m"))
    one = rows.select(
        "doc_id",
        F.col("m.start").cast("long").alias("start"),
        F.get("runs", F.col("i")).alias("value"),
        F.col("m.before").alias("before"),
        F.left(F.get("gaps", F.col("i") + 1), F.lit(8)).alias("after"),
    )
    # One character over and over is a rule or a filler.
    return one.where(F.col("value").rlike("[A-Za-z0-9]") & ~F.col("value").rlike(r"^(.)\1*+$")).withColumn("end", F.col("start") + F.length("value"))


def labelled_findings(spark: SparkSession, each: int = 160, first: int = 0) -> DataFrame:
    """Findings (value, before, after, label) made by rule: ``each`` of every kind of secret and of look-alike, numbered from ``first``."""
    n = F.col("id").cast("string")
    hexes = lambda tag, k: F.substring(F.sha2(F.concat(F.lit(tag), n), 512), 1, k)
    b64 = lambda tag, k: F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit(tag), n), 512))), "+/=", "xYz"), 1, k)
    word = lambda tag, k: F.element_at(F.array(*[F.lit(w) for w in DICTIONARY]), (F.pmod(F.xxhash64(n, F.lit(tag + str(k))), F.lit(len(DICTIONARY))) + 1).cast("int"))
    varied = lambda tag, low, high: F.pmod(F.xxhash64(n, F.lit(tag)), F.lit(high - low + 1)).cast("int") + low
    cut = lambda value, tag, low, high: F.substring(value, F.lit(1), varied(tag, low, high))
    pick = lambda tag, *choices: F.element_at(F.array(*[F.lit(c) for c in choices]), varied(tag, 1, len(choices)))
    kinds = [
        (1, cut(hexes("a", 64), "al", 16, 40), pick("ab", "the password=", "login passwd: ", "pwd = \"", "secret: '", "set PASSWORD="), pick("aa", " ", "\"", "\n", ";")),
        (1, cut(hexes("b", 64), "bl", 24, 64), pick("bb", "token = \"", "auth_token: ", "access token ", "API_KEY=", "client_secret: \""), pick("ba", "\" ", "\n", ",", " ")),
        (1, cut(b64("c", 64), "cl", 20, 60), pick("cb", "api_key = '", "apikey: ", "Authorization: Bearer ", "secret_key=", "private key: "), pick("ca", "' ", "\n", "&", " ")),
        (1, F.concat(pick("dp", "ghp_", "sk_live_", "npm_", "glpat-", "hf_"), cut(b64("d", 64), "dl", 24, 36)), pick("db", "see ", "export X=", "\"", "value: ", "and "), pick("da", " ", "\"", "\n", ".")),
        (1, F.concat(F.lit("AKIA"), F.upper(hexes("e", 16))), pick("eb", "key ", "aws_access_key_id = ", "", "id: "), pick("ea", " ", "\n", ",")),
        (0, hexes("f", 40), pick("fb", "commit ", "at revision ", "sha1 ", "merge of commit ", "Change hash "), pick("fa", " ", "\n", ".")),
        (0, hexes("g", 64), pick("gb", "sha256:", "checksum: ", "digest = \"", "integrity sha256 ", "md5 hash "), pick("ga", "\"", "\n", " ")),
        (0, F.concat_ws("-", hexes("h", 8), hexes("h1", 4), hexes("h2", 4), hexes("h3", 4), hexes("h4", 12)), pick("hb", "id=", "uuid: ", "request ", "guid \"", "trace "), pick("ha", " ", "\"", "\n")),
        (0, F.concat(F.lit("/"), word("i", 1), F.lit("/"), word("i", 2), varied("iv", 1, 99).cast("string"), F.lit("/"), word("i", 3), F.lit("."), word("i", 4)), pick("ib", "open ", "path = \"", "in file ", "from ", ""), pick("ia", "\"", " ", "\n")),
        (0, F.concat(word("j", 1), F.lit("_"), word("j", 2), F.lit("_"), word("j", 3), varied("jv", 1, 999).cast("string")), pick("jb", "call ", "import ", "key = ", "the ", "token "), pick("ja", "(", " ", ".", "\n")),
        (0, F.concat(F.lit("www."), word("k", 1), varied("kv", 1, 99).cast("string"), F.lit("."), word("k", 2), F.lit(".com/"), word("k", 3)), pick("kb", "http://", "see ", "url: ", "href=\""), pick("ka", " ", "\"", "\n")),
        (0, cut(F.translate(hexes("l", 64), "abcdef", "012345"), "ll", 16, 24), pick("lb", "card ", "order ", "phone ", "isbn ", "account no ", ""), pick("la", " ", ".", "\n")),
        (0, F.rpad(pick("mc", "x0", "1", "-9-", "00", "1234"), varied("ml", 16, 40), pick("mc", "x0", "1", "-9-", "00", "1234")), pick("mb", "password: ", "token=", "key ", "", "value "), pick("ma", " ", "\n", "\"")),
        (0, F.concat(varied("nv", 1, 20).cast("string"), F.lit("."), varied("nw", 0, 30).cast("string"), F.lit(".0-"), word("n", 1), F.lit("."), word("n", 2)), pick("nb", "version ", "build ", "release ", "v"), pick("na", " ", "\n", ",")),
        (0, F.concat(word("o", 1), F.lit("."), word("o", 2), varied("ov", 1, 99).cast("string"), F.lit(".example.com")), pick("ob", "user@", "mail to x@", "host ", "://"), pick("oa", " ", "\n", ":")),
        (0, F.concat(word("p", 1), word("p", 2), word("p", 3), varied("pv", 0, 9).cast("string")), pick("pb", "the ", "and then ", "", "of a "), pick("pa", " ", ".", "\n")),
        (0, F.concat(varied("qy", 2000, 2030).cast("string"), F.lit("-"), F.lpad(varied("qm", 1, 12).cast("string"), 2, "0"), F.lit("-01T10-"), F.lpad(varied("qs", 0, 59).cast("string"), 2, "0"), F.lit("-00.000")), pick("qb", "at ", "log ", "time=", ""), pick("qa", " ", "\n")),
        # Short values, values with symbols or of letters only, and long names; what stands in such places without being secret.
        (1, F.concat(F.initcap(word("r", 1)), pick("rs", "&", "!", "#", "$", "%", "@", "*"), varied("rv", 1, 9999).cast("string")), pick("rb", "password: ", "pwd=", "passwd = \"", "DB_PASSWORD=", "login password: '"), pick("ra", " ", "\n", "\"", "'")),
        (1, F.concat(word("s", 1), varied("sv", 1, 99).cast("string"), word("s", 2)), pick("sb", "password=", "the password: ", "passphrase: ", "user_password = '", "PWD="), pick("sa", " ", "\n", "'", "&")),
        (1, F.concat(hexes("t", 3), pick("ts", "!", "^", "~", "?", "+", "$"), b64("t", 8)), pick("tb", "password: ", "secret=", "client_secret: \"", "auth = '", "passcode="), pick("ta", " ", "\n", "\"", "'")),
        (1, F.translate(cut(b64("u", 64), "ul", 18, 40), "0123456789", "qWeRtYuIoP"), pick("ub", "token=", "api_key: ", "secret = \"", "AWS_SECRET_ACCESS_KEY=", "stripe_secret_key_live = "), pick("ua", " ", "\n", "\"", "")),
        (1, F.concat(F.lit("abcdefghijklmnop"), F.translate(hexes("uu", 16), "0123456789", "GHIJKLMNOP")), pick("uub", "token=", "access_token: ", "secret_key='"), pick("uua", " ", "\n", "'", "")),
        (1, cut(hexes("v", 64), "vl", 16, 48), pick("vb", "AWS_SECRET_ACCESS_KEY=", "stripe_secret_key_live = ", "export SERVICE_AUTH_TOKEN_PROD=", "my_application_password_value: "), pick("va", " ", "\n", "\"", "")),
        (0, word("w", 1), pick("wb", "password: ", "token: ", "secret = ", "auth: ", "the password: "), pick("wa", " ", ".", "\n", ",")),
        (0, pick("xv", "${PASSWORD}", "<password>", "{{token}}", "$DB_PASSWORD", "********", "getenv(\"TOKEN", "%(secret)s", "None", "null", "true", "required", "Bearer", "changeit"), pick("xb", "password=", "token: ", "secret = ", "Authorization: ", "auth="), pick("xa", " ", "\n", "\"", ")")),
        (0, F.concat(word("y", 1), word("y", 2), word("y", 3), word("y", 4)), pick("yb", "the ", "and then ", "of a ", "", "with its "), pick("ya", " ", ".", ",", "\n")),
        (0, F.concat(pick("z1", "inter", "trans", "under", "ver", "re", "con"), pick("z2", "nation", "form", "stand", "ant", "duc"), pick("z3", "alis", "ation", "ing", "wort", "tif"), pick("z4", "ierung", "ement", "ability", "ically", "lichkeit")), pick("zb", "the ", "die ", "of ", "and ", "secret of the "), pick("za", " ", ".", ",", "\n")),
        (0, F.concat(word("aa", 1), pick("as", "_", "-", "/", "."), word("aa", 2), pick("as", "_", "-", "/", "."), word("aa", 3)), pick("ab2", "the ", "call ", "in ", "token ", "key = "), pick("ac", " ", "(", "=", "\n")),
    ]
    ids = spark.range(first, first + each)
    made = None
    for label, value, before, after in kinds:
        part = ids.select(value.alias("value"), before.alias("before"), after.alias("after"), F.lit(float(label)).alias("label"))
        made = part if made is None else made.unionByName(part)
    return made


def train(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel:
    """A forest fitted on labelled findings (value, before, after, label); rows without a label aren't used.

    Findings that don't hold both labels, as an empty table, can't tell secrets from others: those of
    ``labelled_findings`` are added to them.
    """
    findings = findings.where("label IS NOT NULL")
    if findings.agg(F.count_distinct("label")).first()[0] < 2:
        findings = findings.select("value", "before", "after", "label").unionByName(labelled_findings(findings.sparkSession))
    # Few rows, read many times: written once, in few files.
    held = written(features(findings).select(*FEATURES, "label").coalesce(2), "findings")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(held)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows.select("features", "label"))


def secret_scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: doc_id, start, end (code points), value_sha256, score, secret.

    A candidate is a value of 4 to 256 characters assigned to a credential's name, or a run of 16 or more key characters;
    a shorter value with no such name before it is none, nor is one character over and over. The value itself isn't
    returned. A null or empty text has no candidates; a null id is passed through; repeated
    rows give repeated findings; an empty table gives none. Other columns are ignored, whatever their names.
    """
    model = train(findings if findings is not None else labelled_findings(docs.sparkSession))
    found = features(candidates(docs, id_col, text_col))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), score.alias("score")).withColumn("secret", F.col("score") >= threshold)
