"""Secret scans: candidates by one regular expression, false positives removed by a random forest.

Everything on the rows is DataFrame functions. A candidate is a private key block, the value of an assignment (after
a key word whatever its characters), the password of an address, or a run of key characters with a digit or a known
prefix in it, of any length; the text around it gives its neighbouring words. Three passes mark where values begin, one
more marks the candidates, the text is split at the marks, and every candidate becomes a row with its place and surroundings, so a text
costs as much as it is long. A forest, grown on the driver from a bounded table of labelled findings, is compiled to a
column expression over measures of the candidate: its length, transitions between kinds of characters, coverage by
dictionary words, the path it stands in and the words around it.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import written

#: Labelled findings that training reads at most: those of the smallest hashes.
TRAIN_FINDINGS = 3_600
TREES, DEPTH, LEAST = 15, 6, 3
#: Characters of a candidate, and how much of the text before and after it counts as neighbouring.
KEY = r"A-Za-z0-9+/_.\-"
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|eyJ|npm_|pypi-"
WORDS = "key|token|secret|passw|passphrase|pass(?![a-z])|(?<![a-z])pw(?![a-z])|pwd|auth|bearer|credential|private|signature"
#: What may stand between a key word and the = or : after it, and those.
GAP, SET = r"\w \t\"'.\-\]", r"(?::=|=>|[=:])"
# Contexts of values. Each is marked by a control character where the value begins, in a pass over the text of its own;
# so names, gaps, blanks and users may be of any length, and what stands in them can be a candidate as well.
#: A run of gap characters with a key word in it, then = or : and what may open a value.
KEYED = rf"""(?<![{GAP}])(?=[{GAP}]*+{SET})(?=[{GAP}]*?(?i:{WORDS}))[{GAP}]*+{SET}[ \t]*+["']?"""
#: Another name and =, a quoted name and : before a quoted value, or a scheme of authorization.
NAMED = rf"""(?<=\w)["'\]]?[ \t]*+(?::=|=>|=)[ \t]*+["']?|(?<=\w)["'][ \t]*+:[ \t]*+["'](?=[^\s"'])|(?<!\w)(?i:bearer|basic)[ \t]++"""
#: The scheme and user of an address whose password follows.
USER = r"""://[^\s/@:"']*+:(?=[^\s/@"']++@[\w\[])"""
_KEY_MARK, _NAME_MARK, _USER_MARK = "\x04", "\x05", "\x06"
_MARKS = _KEY_MARK + _NAME_MARK
#: A private key up to its END line, headers included, not past the BEGIN line of another.
BLOCK = r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:(?!-----(?:BEGIN|END) )-[^-]*+)*+-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
#: A value up to its closing quote, or else up to white space, a quote that ends it, the next field of an address or a tag.
QUOTED = rf"""(?<="[{_MARKS}]{{1,4}})[^"\n]++(?=")|(?<='[{_MARKS}]{{1,4}})[^'\n]++(?=')"""
BARE = r"""[^\s"'&<](?:[^\s"'&<]|&(?!\w{1,30}=)|<(?!/)|["'](?=[A-Za-z0-9]))*+"""
ASSIGNED = rf"(?<=[{_MARKS}])(?![{_MARKS}])(?!(?i:bearer|basic)[ \t]\S)(?:{QUOTED}|{BARE})"
#: The password of an address, up to the last @ before the host.
ADDRESS = rf"""(?<={_USER_MARK})[^\s/@"']++(?=@[\w\[])"""
CANDIDATE = rf"{BLOCK}|{ADDRESS}|{ASSIGNED}|(?<![{KEY}])(?:{PREFIXES})[{KEY}]++={{0,2}}|(?<![{KEY}])[A-Za-z+/_.\-]*+[0-9][{KEY}]*+={{0,2}}"
#: Characters at the end of a candidate that belong to the sentence or the code around it.
CLOSING = r"[,;:)\]}>]+$"
BEFORE, AFTER = 48, 24
#: So many parts of a text (a candidate and what follows it) give the text before the next candidate.
PARTS = 6
MARK = "[SECRET]"

DICTIONARY = (
    "about access account admin after again all also and any app are asset backup base been before build but cache can case change class client cloud code com commit config content core could create css data date db default dev did doc docs down each east edit email end error event example false file files first font for form from get group guide has have her here his home host how html http https icon image img in index info into item java job json key keys last left lib like link list local log login mail main make man master may media message model module more most name net new news next node not null object off on one only or order org other our out over page part path people php plan png port post prod product public query release report request right root sample save script search secret section see self server service session she should site size some source src state static style sub system table tag team temp test text than that the their them then there these they this time title token tool top true two type uk up update url us use user users value version video view was way web week well were west what when where which who will with work world www xml year yes you your"
).split()

# The measures by name; a tree's splits refer to their order.
FEATURES = ["length", "transitions", "changes", "distinct", "digits", "uppers", "hex", "dictionary", "separators", "dots", "slashes", "longest_letters", "longest_digits", "in_path", "after_at", "word_key", "word_hash", "assigned", "quoted", "prefix", "keyed"]


def _runs(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(.)\1*+", "$1"))


def _share(c: Column, pattern: str) -> Column:
    """The share of characters that a regular expression takes away."""
    return 1.0 - F.length(F.regexp_replace(c, pattern, "")) / F.greatest(F.length(c), F.lit(1))


def measures(before: Column, value: Column, after: Column, keyed: Column | None = None) -> Column:
    """The array of measures, in the order of FEATURES; ``keyed``: whether a key word and = or :, or an address's user, precede (else ``before`` tells)."""
    keyed = before.rlike(rf"""(?i)({WORDS})[{GAP}]*{SET}[ \t]*["']?$|://[^\s/@:"']*:$""") if keyed is None else keyed
    low, high, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = F.translate(value, low + high + digit, "a" * 26 + "A" * 26 + "0" * 10)
    n = F.greatest(F.length(value), F.lit(1))
    words = "(?i)(" + "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w))) + ")"
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    rows = [
        F.length(value),
        _runs(kinds) - 1,
        (_runs(kinds) - 1) / n,
        F.size(F.array_distinct(F.split(value, ""))) / n,
        _share(value, "[0-9]"),
        _share(value, "[A-Z]"),
        _share(value, "[0-9a-fA-F]"),
        _share(value, words),
        _share(value, "[^A-Za-z0-9]"),
        _share(value, r"\."),
        _share(value, "/"),
        F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), lambda x: F.length(x))),
        F.array_max(F.transform(F.split(value, "[^0-9]+"), lambda x: F.length(x))),
        flag(before.rlike(r"(://|[?&/\\@])[^\s]*$") | value.rlike("^/|://") | keyed & after.rlike("^@")),
        flag(after.rlike("^@") | before.rlike(r"@$")),
        flag(before.rlike(rf"(?i)({WORDS})[^\n]{{0,16}}$")),
        flag(before.rlike(r"(?i)(sha|md5|hash|digest|checksum|integrity|commit|uuid|guid|version|revision|build|serial|isbn|etag|phone|tel|card|ip|address|order|id)[^a-zA-Z\n]{0,6}$")),
        flag(before.rlike(r"[=:]\s?['\"]?$")),
        flag(before.rlike(r"['\"]$") & after.rlike(r"^['\"]")),
        flag(value.rlike(f"^({PREFIXES}|-----BEGIN)")),
        flag(keyed),
    ]
    return F.array(*[r.cast("double") for r in rows])


@dataclass
class Node:
    """A leaf with the share of secrets, or a split: feature <= at goes left."""

    share: float
    feature: int = -1
    at: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def column(self, x: Column) -> Column:
        if self.left is None or self.right is None:
            return F.lit(self.share)
        return F.when(F.get(x, F.lit(self.feature)) <= self.at, self.left.column(x)).otherwise(self.right.column(x))

    def value(self, x: list[float]) -> float:
        node = self
        while node.left is not None and node.right is not None:
            node = node.left if x[node.feature] <= node.at else node.right
        return node.share


def _impurity(ones: int, n: int) -> float:
    return 2 * ones * (n - ones) / n if n else 0.0


def _grow(rows: list[tuple[list[float], int]], depth: int, draw: random.Random) -> Node:
    ones, n = sum(y for _, y in rows), len(rows)
    node = Node((ones + 0.5) / (n + 1))
    if depth == 0 or ones in (0, n) or n < 2 * LEAST:
        return node
    best = (_impurity(ones, n) - 1e-9, -1, 0.0)
    for f in draw.sample(range(len(FEATURES)), 6):
        ordered = sorted((x[f], y) for x, y in rows)
        left = 0
        for i in range(n - 1):
            left += ordered[i][1]
            if ordered[i][0] < ordered[i + 1][0] and LEAST <= i + 1 <= n - LEAST:
                cost = _impurity(left, i + 1) + _impurity(ones - left, n - i - 1)
                if cost < best[0]:
                    best = (cost, f, (ordered[i][0] + ordered[i + 1][0]) / 2)
    if best[1] < 0:
        return node
    _, node.feature, node.at = best
    node.left = _grow([r for r in rows if r[0][node.feature] <= node.at], depth - 1, draw)
    node.right = _grow([r for r in rows if r[0][node.feature] > node.at], depth - 1, draw)
    return node


@dataclass
class Forest:
    trees: list[Node]

    def column(self, x: Column) -> Column:
        """The mean share of the trees' leaves, as an expression over the array of measures."""
        return reduce(lambda a, b: a + b, [t.column(x) for t in self.trees]) / len(self.trees)

    def value(self, x: list[float]) -> float:
        return sum(t.value(x) for t in self.trees) / len(self.trees)


def example_findings(spark: SparkSession, n: int = 3_600) -> DataFrame:
    """Labelled findings (before, value, after, label) made by rule: secrets of common forms, and what looks like them."""
    i = F.col("id")
    h = lambda k, m: F.sha2(F.concat_ws("-", i, F.lit(k)), 256).substr(1, m)
    mixed = lambda k, m: F.translate(F.base64(F.unhex(F.sha2(F.concat_ws("-", i, F.lit(k)), 512))), "\n=", "").substr(1, m)
    number = lambda k, m: F.conv(h(k, 8), 16, 10).cast("long") % m
    digits = lambda k, m: F.lpad(F.conv(h(k, 12), 16, 10), 20, "7").substr(21 - m, m)
    one = lambda k, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (number(k, len(xs)) + 1).cast("int"))
    upper = F.upper(F.translate(mixed("k", 40), "+/01abc89", "QRSTUVWXY")).substr(1, 16)
    word = one("w", "the report of ", "and here is ", "then we saw ", "value is ", "les autres de ", "und der ", "para los ", "")
    key = one("key", "token", "api_key", "secret", "password", "passwd", "auth_token", "client_secret", "private_key", "access_token")
    assign = one("as", "=", " = ", ": ", "=\"", " = \"", ": \"", "='")
    closing = F.when(F.endswith(assign, F.lit('"')), '"').when(F.endswith(assign, F.lit("'")), "'").otherwise("")
    named = F.concat(word, key, assign)
    letters = lambda k, m: F.translate(mixed(k, m), "+/0123456789", "QgTzKpLmRsYb")
    symbols = F.concat(mixed("sy", 5), one("s1", "!", "#", "$", "!x"), letters("sz", 4), one("s2", "%", "^k", "*", "@"), mixed("s3", 5))
    coined = F.concat(*[one(f"c{k}", "correct", "horse", "battery", "staple", "purple", "monkey", "dragon", "winter", "velvet", "copper", "rocket", "tulip") for k in range(4)])
    other = F.concat(word, one("on", "OAUTH2_TOKEN", "S3_SECRET", "DB2_PASSWORD", "GITHUB_PAT", "db_pass", "x"), one("oa", "=", "=\"", " = \""))
    ends = F.when(F.endswith(other, F.lit('"')), '"').otherwise(" ")
    asking = F.concat(word, one("ak", "password: ", "Password: ", "key: ", "token: ", "the secret: ", "author: ", "authors = ", "keywords: ", "key = ", "signature: "))
    prose = lambda k: one(k, "required", "important", "international", "communication", "understanding", "Johnathan", "everything", "responsibility", "available", "optional", "yesterday", "together", "patience", "information", "development")
    blank = F.concat(word, one("bk", "name=", "class=", "title = ", "type=", "href=", "mode = ", "name=\"", "class=\""))
    shut = F.when(F.endswith(blank, F.lit('"')), '"').otherwise(" ")
    kinds = [
        (word, F.concat(F.lit("AKIA"), upper), F.lit(" "), 1),
        (named, F.concat(F.lit("AKIA"), upper), closing, 1),
        (named, h("a", 40), closing, 1),
        (named, h("b", 32), closing, 1),
        (F.concat(word, one("p", "password=", "passwd=", "pwd: ", "password = ", "Password: ")), h("c", 18), F.lit(" "), 1),
        (F.concat(word, one("p", "password=", "passwd=", "pwd: ", "password = ", "Password: ")), F.concat(h("c", 10), mixed("d", 6)), F.lit(" "), 1),
        (named, mixed("e", 24), closing, 1),
        (named, mixed("f", 40), closing, 1),
        (word, F.concat(F.lit("ghp_"), F.translate(mixed("g", 36), "+/", "Aa")), F.lit(" "), 1),
        (word, F.concat(F.lit("sk_live_"), F.translate(mixed("g", 24), "+/", "Aa")), F.lit(" "), 1),
        (word, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), mixed("h", 64), F.lit("\n-----END RSA PRIVATE KEY-----")), F.lit("\n"), 1),
        (F.concat(F.lit("Authorization: Bearer "), F.lit("")), F.concat(F.lit("eyJ"), F.translate(mixed("i", 50), "+/", "_-")), F.lit("\n"), 1),
        (word, F.concat_ws(".", number("1", 255), number("2", 255), number("3", 255), number("4", 255)), F.lit(" "), 0),
        (word, F.concat(F.lit("4"), digits("5", 15)), F.lit(" "), 0),
        (F.concat(word, F.lit("+1 (988) ")), F.concat(digits("6", 3), F.lit("-"), digits("7", 4)), F.lit(" "), 0),
        (word, F.concat(one("m", "anna.", "joe_", "info", "team-"), number("8", 99)), F.lit("@mail8.example.com "), 0),
        (F.concat(word, F.lit("bo.42@")), F.concat(F.lit("mail"), number("9", 9), F.lit(".example.com")), F.lit(" "), 0),
        (F.concat(word, one("s", "commit ", "sha256: ", "md5 ", "checksum ", "etag: ", "revision ")), h("j", 40), F.lit(" "), 0),
        (F.concat(word, one("u", "uuid ", "id ", "guid: ", "")), F.concat_ws("-", h("l", 8), h("m", 4), h("n", 4), h("o", 4), h("p", 12)), F.lit(" "), 0),
        (F.concat(word, F.lit("https:")), F.concat(F.lit("//www.example.com/"), one("q", "news/", "static/img/", "2021/05/"), number("r", 99999), one("x", "/index.html", ".png", "/page-2")), F.lit(" "), 0),
        (word, F.concat(one("y", "/usr/lib/python3.", "src/main/v", "assets/app."), number("z", 12), one("t", "/site-packages", "/build/out", ".min.js")), F.lit(" "), 0),
        (F.concat(word, one("v", "version ", "released ", "since ")), F.concat_ws("-", number("aa", 30) + 1990, number("bb", 12) + 10, number("cc", 18) + 10), F.lit(" "), 0),
        (F.concat(word, one("dd", "order ", "item ", "serial ", "call ")), F.concat(one("ee", "SKU-", "ORD", "No.", "X-"), digits("ff", 8)), F.lit(" "), 0),
        (word, F.concat(one("gg", "covid", "windows", "chapter", "section", "python", "area"), one("hh", "-", "_", ""), number("ii", 3000), one("jj", "-update", "_final", "th-report", "a")), F.lit(" "), 0),
    ]
    kinds += [
        (named, letters("k1", 24), closing, 1),
        (named, letters("k2", 16), closing, 1),
        (named, coined, closing, 1),
        (named, symbols, closing, 1),
        (other, h("k3", 40), ends, 1),
        (other, letters("k4", 24), ends, 1),
        (other, mixed("k5", 24), ends, 1),
        (word, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,"), F.upper(h("k6", 32)), F.lit("\n\n"), mixed("k7", 64), F.lit("\n-----END RSA PRIVATE KEY-----")), F.lit("\n"), 1),
        (asking, prose("n1"), F.lit(" "), 0),
        (asking, F.concat(one("n2", "get", "user", "read", "make", "load", "current"), one("n3", "Token", "Value", "Password", "Secret", "Name"), one("n4", "()", "", "_here", "(user)", ".text")), F.lit(" "), 0),
        (asking, F.concat(prose("n5"), F.lit(" "), prose("n6"), F.lit(" "), prose("n7")), F.lit('"'), 0),
        (blank, F.concat(prose("n8"), one("n9", "", "-item", "_view", ".html", "/index")), shut, 0),
        (word, one("nf", "OAUTH2_TOKEN=", "S3_SECRET=", "DB2_PASSWORD=", "KEY1_VALUE="), h("n0", 24), 0),
        (F.concat(word, one("nb", "bearer ", "basic ", "Basic ")), F.concat(prose("nc"), one("nd", "-", "_"), prose("ne")), F.lit(" "), 0),
    ]
    address = F.concat(word, one("ad", "postgres", "mysql", "https", "redis", "amqp", "mongodb"), F.lit("://"), one("au", "admin", "root", "app", "svc_1", ""), F.lit(":"))
    kinds += [
        (address, mixed("a1", 14), F.lit("@db.example.com"), 1),
        (address, coined, F.lit("@10.0.0.5:5432"), 1),
        (address, h("a2", 9), F.lit("@host/name"), 1),
        (address, F.concat(one("a5", "correct", "horse", "battery", "staple", "purple", "", "monkey"), one("a6", "dragon", "winter", "velvet", "copper", "rocket", "tulip", "hunter")), one("a7", "@db.example.com/x", "@h", "@10.0.0.5:5432"), 1),
        (address, F.lower(letters("a8", 10)), one("a7", "@db.example.com/x", "@h", "@10.0.0.5:5432"), 1),
        (address, F.concat(letters("a3", 6), one("a4", "!", "1", "99")), F.lit("@cache.local"), 1),
        (named, F.concat_ws("-", *[one(f"b{k}", "correct", "horse", "battery", "staple", "purple", "monkey", "dragon", "winter", "velvet", "copper", "rocket", "tulip") for k in range(4)]), closing, 1),
        (F.concat(word, one("q1", "password=", "pwd=", "passwd: ", "password = \"", "pwd='")), F.concat(letters("b5", 4), number("b6", 99)), one("q2", "\"", "'", " "), 1),
        (F.concat(word, one("q1", "password=", "pwd=", "passwd: ", "password = \"", "pwd='")), F.concat(letters("b7", 3), one("b8", "!", "#1", "$x", "7")), one("q2", "\"", "'", " "), 1),
        (word, number("b9", 99999).cast("string"), F.lit(" "), 0),
        (word, F.concat(number("bA", 99), one("bB", "th", "st", "km", "x", "%", "")), F.lit(" "), 0),
        (word, F.concat(letters("bJ", 2), number("bK", 99)), one("bL", " ", ",", ".", "\n"), 0),
        (word, F.concat(one("bM", "x", "an", "Ti", "room", "B", "area", "mid", "iso", "Web"), number("bN", 99)), one("bO", " ", ",", ".", "\n"), 0),
        (word, F.concat(number("bP", 9), letters("bQ", 3)), one("bL", " ", ",", ".", "\n"), 0),
        (F.concat(word, one("bC", "integrity=\"", "integrity: \"", "checksum = \"", "digest: ")), F.concat(one("bD", "sha512-", "sha384-", "sha256-"), mixed("bE", 60), F.lit("==")), F.lit('"'), 0),
        (asking, one("bF", "yes", "no", "none", "true", "null", "a", "the", "my", "your", "it", "see", "1", "0", "***", "xxx"), F.lit(" "), 0),
        (blank, one("bG", "a", "btn", "1", "12", "en", "utf-8", "x1", "main", "100%"), shut, 0),
        (F.concat(word, one("bH", "http", "https", "ftp"), F.lit("://www.example.com:")), number("bI", 9999).cast("string"), F.lit("/index"), 0),
    ]
    secret_name = one("c1", "password", "passwd", "pwd", "pass", "secret", "db_password", "passphrase", "admin_password")
    open_value = F.concat(word, F.concat(one("c2", "", "", "\"", "'"), secret_name, one("c3", "", "", "\"", "'")), one("c4", " = \"", "=\"", ": \"", ":\"", " => \"", " := \""))
    short = one("c5", "hunter", "hunter2", "letmein", "dragon", "swordfish", "trustno1", "qwerty", "sunshine", "tulip", "rosebud")
    long_name = F.concat(word, one("d1", "password", "token", "secret", "api_key"), one("d2", "_for_the_production_database", "_of_the_billing_service_account", " of the old mail server", "_value_in_staging"), one("d3", " = ", "=", ": ", "   =   ", " = \""))
    scheme = F.concat(word, one("e1", "bearer", "Bearer", "basic", "Basic", "BASIC"), F.lit(" "))
    field = F.concat(word, one("f1", "{\"name\": \"", "\"title\":\"", "\"type\": \"", "\"city\":\"", "\"lang\": \"", "label=\"", "\"status\":\"", "'role': '"))
    kinds += [
        (open_value, short, F.lit('"'), 1),
        (open_value, F.concat(letters("c6", 3), one("c7", "!", "#", "@", "$", "-"), letters("c8", 3)), F.lit('"'), 1),
        (open_value, F.concat(F.lower(letters("c9", 6)), one("cA", "", "1", "!")), F.lit('"'), 1),
        (open_value, one("cB", "", "*****", "<password>", "your password here", "not set", "none", "null", "changed last week", "{password}", "xxxx", "required", "optional"), F.lit('"'), 0),
        (long_name, letters("d4", 20), one("d5", " ", "\"", "\n"), 1),
        (long_name, h("d6", 24), one("d5", " ", "\"", "\n"), 1),
        (long_name, coined, one("d5", " ", "\"", "\n"), 1),
        (long_name, prose("d7"), one("d8", " ", ".", "\n"), 0),
        (asking, F.concat(F.lower(letters("g1", 5)), one("g2", "", "s", "ing", "ed")), one("g3", " ", ".", ",", "\n"), 0),
        (F.concat(word, one("g4", "the secrets of success: ", "tokens of thanks: ", "the key of all this: ", "the author says: ", "private letters: ", "signature of the mayor: ")), F.concat(F.lower(letters("g5", 6)), one("g2", "", "s", "ing", "ed")), one("g3", " ", ".", ",", "\n"), 0),
        (scheme, mixed("e2", 12), one("e3", " ", "\n", "\""), 1),
        (scheme, F.concat(F.translate(F.base64(F.encode(F.concat(one("e4", "user", "admin", "bo"), F.lit(":"), letters("e5", 5)), "UTF-8")), "\n", "")), one("e3", " ", "\n", "\""), 1),
        (scheme, prose("e6"), one("e7", " ", ".", ",", "\n"), 0),
        (scheme, one("e8", "of", "English", "training", "rights", "needs", "and", "income", "research", "knowledge", "the", "bonds", "plan"), one("e7", " ", ".", ",", "\n"), 0),
        (field, prose("f2"), one("f3", "\"", "'"), 0),
        (field, one("f4", "Bob", "en", "open", "draft", "Paris", "left", "active", "main", "a-b", "v2", "item1", "Ana!", "ok"), one("f3", "\"", "'"), 0),
        (F.concat(word, one("f5", "\"dbpass\":\"", "\"db_pw\": \"", "\"dbpass\": \"", "smtp_pass=\"")), F.concat(letters("f6", 5), one("f7", "!", "#", "7", "")), F.lit('"'), 1),
    ]
    parts = []
    for at in range(0, len(kinds), 10):  # by parts, which Java methods can hold
        cases = F.array(*[F.struct(b.alias("before"), v.alias("value"), a.alias("after"), F.lit(y).alias("label")) for b, v, a, y in kinds[at : at + 10]])
        rows = spark.range(n).filter((i % len(kinds) >= at) & (i % len(kinds) < at + 10))
        parts.append(rows.select(F.inline(F.array(F.element_at(cases, (i % len(kinds) - at + 1).cast("int"))))))
    return reduce(DataFrame.unionAll, parts)


def grow(findings: DataFrame, limit: int = TRAIN_FINDINGS, seed: int = 3) -> Forest:
    """A forest from at most ``limit`` labelled findings (before, value, after, label), whose measures the driver reads."""
    rows = findings.orderBy(F.xxhash64("before", "value", "after")).limit(limit).select(measures(F.coalesce("before", F.lit("")), F.coalesce("value", F.lit("")), F.coalesce("after", F.lit(""))).alias("x"), F.col("label").cast("int").alias("y")).collect()
    sample = sorted((list(r["x"]), int(r["y"] == 1)) for r in rows)
    draw = random.Random(seed)
    return Forest([_grow([draw.choice(sample) for _ in sample], DEPTH, draw) for _ in range(TREES)] if sample else [Node(0.0)])


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated once: a generator of one row, which the optimizer can't copy into its users."""
    return df.withColumn(name, F.explode_outer(F.array(value)))


def _starts(lengths: Column, block: int = 256) -> Column:
    """Sums of the lengths before each element, in blocks, so that the cost is linear."""
    none = F.array().cast("array<int>")

    def sums(xs: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), none.alias("done"))
        return F.aggregate(xs, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["done"], acc["at"]).alias("done")), lambda acc: acc["done"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, F.lit(block)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda x, n: x + n)
    return F.flatten(F.zip_with(blocks, sums(F.transform(blocks, total), F.lit(0)), sums))


def candidates(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """A row per candidate: the columns ``keep``, __start (characters from 0), __value, __before, __after and __keyed.

    ``__keyed`` says whether a key word and = or :, or the user of an address, precede. The control characters 1, 2 and 4 to 6, which mark candidates and
    their contexts meanwhile, count as the control character 3. Every pass is linear in the text.
    """
    mark, end, contexts = "\x01", "\x02", _MARKS + _USER_MARK
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*keep, text.alias("__text"))
    marked = F.translate("__text", mark + end + contexts, "\x03" * 5)
    for context, sign in ((KEYED, _KEY_MARK), (NAMED, _NAME_MARK), (USER, _USER_MARK)):
        marked = F.regexp_replace(marked, context, f"$0{sign}")
    marked = F.regexp_replace(marked, CANDIDATE, f"{mark}$0{end}")
    rows = _once(rows, "__signed", F.split(marked, mark)).filter(F.size("__signed") > 1)
    rows = _once(rows, "__parts", F.transform("__signed", lambda p: F.translate(p, contexts, "")))
    parts = F.col("__parts")
    rows = _once(rows, "__at", _starts(F.transform(parts, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))))

    def cut(i: Column) -> Column:
        value = F.regexp_replace(F.substring_index(F.get(parts, i), end, 1), CLOSING, "")
        piece = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
        head = lambda k, n: F.translate(F.left(piece(k), n + 1), end, "")
        before = F.concat(*[F.right(F.translate(F.right(piece(i - k), F.lit(BEFORE + 1)), end, ""), F.lit(BEFORE)) for k in range(PARTS, 0, -1)])
        after = F.concat(F.substr(head(i, F.length(value) + AFTER), F.length(value) + 1), head(i + 1, F.lit(AFTER)), head(i + 2, F.lit(AFTER)))
        return F.struct(F.get(F.col("__at"), i).alias("__start"), value.alias("__value"), F.right(before, F.lit(BEFORE)).alias("__before"), F.left(after, F.lit(AFTER)).alias("__after"), F.right(F.get(F.col("__signed"), i - 1), F.lit(1)).isin(_KEY_MARK, _USER_MARK).alias("__keyed"))

    found = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), cut)
    return rows.select(*keep, F.inline(found)).filter("__value <> ''")


def judged(docs: DataFrame, forest: Forest, keep: list[str], text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The candidates that the forest keeps: the columns ``keep``, __start, __value and __score."""
    rows = _once(candidates(docs, keep, text_col), "__x", measures(F.col("__before"), F.col("__value"), F.col("__after"), F.col("__keyed")))
    rows = _once(rows, "__score", forest.column(F.col("__x")))
    return rows.filter(F.col("__score") >= least).select(*keep, "__start", "__value", "__score")


def find_secrets(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per secret: doc_id, start, n_chars, secret_sha256 (the secret itself is not spread further), score.

    ``start`` counts characters from 0. A null or empty text has no secret, an empty table gives an empty one. Nothing is
    shuffled: each row is handled alone, so repeated rows are reported each, a null doc_id stays, and clashing names of
    other columns don't matter. Of candidates that overlap the first one counts.
    """
    rows = judged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), forest, ["doc_id"], "text", least)
    return rows.select("doc_id", F.col("__start").alias("start"), F.length("__value").alias("n_chars"), F.sha2("__value", 256).alias("secret_sha256"), F.col("__score").alias("score"))


def redact_secrets(docs: DataFrame, forest: Forest, text_col: str = "text", mark: str = MARK, least: float = 0.5) -> DataFrame:
    """``docs`` with every secret of the text column replaced by ``mark`` where it stands; the other columns stay as they are.

    Rows are told apart by two hashes of their text (together 128 bits), so rows of one text are searched for each and
    get the same result; null and empty texts stay. The findings are written; if they are few (Spark's own threshold on
    the size of what was written decides) they are broadcast, otherwise both sides are dealt by the hashes.
    """
    both = lambda t: (F.xxhash64(t).alias("__a"), F.xxhash64(F.lit("again"), F.reverse(t)).alias("__b"))
    text = F.col(text_col).cast("string")
    found = judged(docs.select(*both(text), text.alias("__t")), forest, ["__a", "__b"], "__t", least)
    places = written(found.select("__a", "__b", F.struct(F.col("__start").alias("start"), F.length("__value").alias("n")).alias("s")).groupBy("__a", "__b").agg(F.sort_array(F.collect_set("s")).alias("__found")), "secret-places")
    # the row travels as one column, so that its own names can't clash with those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), text.alias("__t"), *both(text)).join(places, ["__a", "__b"], "left")

    def put(acc: Column, s: Column) -> Column:
        return F.struct((s["start"] + s["n"]).alias("at"), F.array_append(F.array_append(acc["done"], F.substr("__t", acc["at"] + 1, s["start"] - acc["at"])), F.lit(mark)).alias("done"))

    clean = F.aggregate("__found", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("done")), put, lambda acc: F.concat(F.concat_ws("", acc["done"]), F.substr("__t", acc["at"] + 1)))
    own = lambda c: F.col("__row").getField(c)
    return rows.select(*[(F.when(F.size("__found") > 0, clean).otherwise(own(c)) if c == text_col else own(c)).alias(c) for c in docs.columns])


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), grow(example_findings(spark)))
