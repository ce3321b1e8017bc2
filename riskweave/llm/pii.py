"""PII surrogates, with DataFrame functions only.

Mentions of personal data are found by one pattern. Each has a type and a normal form, on which mentions of the same entity agree
whatever their layout (digits of a number, lower case of an address, the name without its title). An entity's surrogate is
a keyed function of type, normal form and attempt: digits stay digits and letters stay letters of their case and script,
a card keeps its first digit and stays valid by its check digit, a phone number keeps its leading country digit, octets stay
octets, an address keeps its shape and top-level domain (its domain being an entity and a surrogate of its own, so people of one
domain stay together and those of two don't meet), and a name gets a first name of the title's gender. A number of ten digits
with and without +1 is one entity. The surrogate is laid out like the mention.

Collision checks run over all distinct entities: an entity whose surrogate another one also has, or that is itself an
entity of the same type, takes the next attempt, until none collides; of those that share a surrogate the first in order keeps it.
Domains are settled before the addresses that hold them. Where a shape has fewer surrogates than entities (all two-letter domains, say), attempts
from LONGER on add letters, one more with each, so the rounds end whatever the corpus holds; only numbers can't grow, whose shapes have
a hundred million surrogates and more.
Only documents with such an entity are looked up again.

Edge cases: a null text stays null, an empty one empty; texts without mentions come back unchanged, byte for byte; repeated
rows get the same text; an empty table gives an empty result; columns other than text are kept as they are. Patterns start at word
boundaries and take runs of address characters without backtracking, so very long texts take linear time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common

#: The key that `replaced` takes where none is given, for tests and the contract's query. Whoever knows a key can tell whether a guess was replaced.
SECRET = "riskweave"
#: The first attempt that adds letters to an address, a domain, a name or a code.
LONGER = 6
#: Rounds of new attempts before giving up with an error, which takes a kind of number that is used up.
ROUNDS = 50

EMAIL = r"(?<![._%+\-])[A-Za-z0-9._%+\-]++@(?=[A-Za-z0-9])[A-Za-z0-9.\-]*\.[A-Za-z]{2,24}"
NAMED = r"(?i:api[_\-]?key|access[_\-]?key|secret|token|password|passwd|pwd)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z_\-./+]*+[0-9])[A-Za-z0-9_\-./+]{8,}+"
CODE = r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36}(?![0-9A-Za-z])|sk-[A-Za-z0-9\-_]{20,}+|eyJ[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]++"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
MALE, FEMALE = "Mr|Mister|Herr|Monsieur|Señor|Г-н|Господин", "Mrs|Ms|Miss|Frau|Madame|Señora|Г-жа|Госпожа"
NAME = rf"(?:{FEMALE}|{MALE})\.? \p{{Lu}}[\p{{L}}'\-]++(?: \p{{Lu}}[\p{{L}}'\-]++)?"
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
PHONE = r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])"
CARD = r"[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"
MENTION = rf"(?<![A-Za-z0-9])(?:{EMAIL}|{NAMED}|{CODE}|{IBAN}|{NAME}|{IP}|{SSN}|{CARD}|{PHONE})"

#: Letters that replace each other: of one script and case.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщыэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
LATIN_ODD = ("[à-öø-ÿ]", "[À-ÖØ-Þ]")
FIRST = {
    "male": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul"],
    "female": ["Anna", "Berta", "Clara", "Diana", "Emma", "Frida", "Greta", "Helena", "Ida", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
}


def kind(m: Column) -> Column:
    """The type of a mention."""
    return (
        F.when(m.contains("@"), "email").when(m.rlike(rf"^(?:{NAMED})$") | m.rlike(rf"^(?:{CODE})$"), "secret").when(m.rlike(rf"^(?:{FEMALE})\b"), "female").when(m.rlike(rf"^(?:{MALE})\b"), "male")
        .when(m.rlike("^[A-Z]{2}"), "iban").when(m.rlike(f"^{IP}$"), "ip").when(m.rlike(f"^{SSN}$"), "ssn").when(m.rlike(f"^(?:{CARD})$"), "card").otherwise("phone")
    )


def value(m: Column, k: Column) -> Column:
    """What of the mention is replaced: all but the name of a secret or a title."""
    named = F.regexp_extract(m, r"[=:]\s{0,3}[\"']?([A-Za-z0-9_\-./+]+)$", 1)
    title = F.regexp_replace(m, rf"^(?:{FEMALE}|{MALE})\.? ", "")
    return F.when((k == "secret") & (named != ""), named).when(k.isin("female", "male"), title).otherwise(m)


def normal(k: Column, v: Column) -> Column:
    """The form that mentions of an entity share."""
    return F.when(k.isin("email", "female", "male"), F.lower(v)).when(k == "iban", F.replace(v, F.lit(" "), F.lit(""))).when(k == "phone", F.regexp_replace(F.regexp_replace(v, "[^0-9+]", ""), r"^\+1(?=[0-9]{10}$)", "")).when(k.isin("card", "ssn"), F.regexp_replace(v, "[^0-9]", "")).otherwise(v)


def _byte(digest: Column, i: Column) -> Column:
    # a digest gives 63 numbers; beyond them a digest of it gives the next 63
    more = F.when(i < 63, digest).otherwise(F.sha2(F.concat(digest, F.floor(i / 63).cast("string")), 512))
    return F.conv(F.substr(more, (i % 63) * 2 + 1, F.lit(4)), 16, 10).cast("int")


def _digest(secret: str, k: Column, norm: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(secret), k, attempt.cast("string"), norm), 512)


def _at(alphabet: str, b: Column) -> Column:
    return F.substr(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))


def _letters(text: Column, digest: Column) -> Column:
    """Each digit by a digit, each letter by one of its case and script; the rest as it is."""
    hexed = text.rlike("^(?=[0-9]*[a-f])[0-9a-f]{16,}$")

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        out = F.when(hexed, _at("0123456789abcdef", b)).when(c.rlike("[0-9]"), _at("0123456789", b))
        for a in ALPHABETS:
            out = out.when(c.rlike(f"[{a}]"), _at(a, b))
        return out.when(c.rlike(LATIN_ODD[0]), _at(ALPHABETS[0], b)).when(c.rlike(LATIN_ODD[1]), _at(ALPHABETS[1], b)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(k: Column, norm: Column, digest: Column) -> Column:
    """The digits of a number's surrogate."""
    d = F.split(F.regexp_replace(norm, "[^0-9]", ""), "")
    plus = norm.startswith("+")

    def one(c: Column, i: Column) -> Column:
        keep = ((k == "card") & (i == 0)) | (plus & (i == 0))
        lead = (i == 0) | (plus & (i == 1))
        b = _byte(digest, i)
        return F.when(keep, c).when(lead, (b % 9 + 1).cast("string")).otherwise((b % 10).cast("string"))

    def luhn(arr: Column, odd: int) -> Column:
        twice = F.transform(F.reverse(arr), lambda c, i: F.when(i % 2 == odd, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
        return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10

    made = F.transform(d, one)
    body = F.slice(made, F.lit(1), F.greatest(F.size(d) - 1, F.lit(1)))
    checked = F.concat(F.array_join(body, ""), ((10 - luhn(body, 0)) % 10).cast("string"))
    return F.when((k == "card") & (luhn(d, 1) == 0), checked).otherwise(F.array_join(made, ""))


def domain(norm: Column) -> Column:
    return F.substring_index(norm, "@", -1)


def _longer(text: Column, dig: Column, attempt: Column) -> Column:
    """text with the letters that late attempts add."""
    n = F.greatest(attempt - (LONGER - 1), F.lit(0))
    return F.concat(text, F.translate(F.substr(dig, F.lit(97), n), "0123456789", "ghijklmnop"))


def _host(name: Column, dig: Column, attempt: Column) -> Column:
    """The surrogate of a domain: its top level stays."""
    top = F.substring_index(name, ".", -1)
    return F.concat(_longer(_letters(F.substr(name, F.lit(1), F.length(name) - F.length(top) - 1), dig), dig, attempt), F.lit("."), top)


def surrogate(k: Column, norm: Column, dig: Column, attempt: Column, host_dig: Column, host_attempt: Column) -> Column:
    """The normal form of an entity's surrogate, from its digest and attempt and its domain's."""
    email = F.concat(_longer(_letters(F.substring_index(norm, "@", 1), dig), dig, attempt), F.lit("@"), _host(domain(norm), host_dig, host_attempt))
    ip = F.concat_ws(".", *[(_byte(dig, F.lit(2 * i)) % 254 + 1).cast("string") for i in range(4)])
    plain = norm.rlike("^[\\x00-\\x7fà-öø-ÿ]*$")
    first = F.when(k == "female", F.element_at(F.array(*map(F.lit, FIRST["female"])), _byte(dig, F.lit(40)) % 16 + 1)).otherwise(F.element_at(F.array(*map(F.lit, FIRST["male"])), _byte(dig, F.lit(40)) % 16 + 1))
    last = F.substring_index(norm, " ", -1)
    named = F.when(plain & norm.contains(" "), F.concat(F.lower(first), F.lit(" "), _longer(_letters(last, dig), dig, attempt))).otherwise(_longer(_letters(norm, dig), dig, attempt))
    iban = F.concat(F.substring(norm, 1, 2), _letters(F.substr(norm, F.lit(3)), dig))
    code = F.concat(F.regexp_extract(norm, "^(AKIA|ASIA|gh[pousr]_|sk-|eyJ|)", 1), _longer(_letters(F.regexp_replace(norm, "^(AKIA|ASIA|gh[pousr]_|sk-|eyJ)", ""), dig), dig, attempt))
    return F.when(k == "email", email).when(k == "domain", _host(norm, dig, attempt)).when(k == "ip", ip).when(k == "secret", code).when(k == "iban", iban).when(k.isin("female", "male"), named).otherwise(F.concat(F.when(norm.startswith("+"), "+").otherwise(""), _digits(k, norm, dig)))


def laid_out(m: Column, k: Column, v: Column, made: Column) -> Column:
    """The surrogate in the layout of the mention."""
    head = F.substr(m, F.lit(1), F.length(m) - F.length(v))
    # an entity of ten digits may be mentioned with its country code
    code = F.when((k == "phone") & ~made.startswith("+") & F.regexp_replace(v, "[^0-9+]", "").rlike(r"^\+1[0-9]{10}$"), "1").otherwise("")
    digits = F.concat(code, F.regexp_replace(made, "[^0-9]", ""))
    spaced = F.when(k == "iban", made).otherwise(digits)
    mask = F.when(k == "iban", "[^0-9A-Z]").otherwise("[^0-9]")
    place = lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substr(spaced, F.length(F.regexp_replace(F.substr(v, F.lit(1), i), mask, F.lit(""))) + 1, F.lit(1))).otherwise(c)
    numbers = F.array_join(F.transform(F.split(v, ""), place), "")
    cased = F.when((k == "email") & (v == F.upper(v)), F.upper(made)).when(k.isin("male", "female"), F.initcap(made)).otherwise(made)
    return F.concat(head, F.when(k.isin("iban", "phone", "card", "ssn"), numbers).otherwise(cased))


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))


def parsed(found: Column) -> Column:
    """Structs (m, k, v, norm) of an array of mentions. Each step is an array of its own, so nothing is worked out twice."""
    step = F.transform(found, lambda m: F.struct(m.alias("m"), kind(m).alias("k")))
    step = F.transform(step, lambda x: F.struct(x.m.alias("m"), x.k.alias("k"), value(x.m, x.k).alias("v")))
    return F.transform(step, lambda x: F.struct(x.m.alias("m"), x.k.alias("k"), x.v.alias("v"), normal(x.k, x.v).alias("norm")))


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, norm) of docs(text)."""
    found = docs.where(F.col("text").rlike(MENTION)).select(F.explode(parsed(mentions(F.col("text")))).alias("x"))
    return found.select(F.col("x.k").alias("kind"), F.col("x.norm").alias("norm")).distinct()


def _made(rows: DataFrame, secret: str = SECRET) -> DataFrame:
    """rows(kind, norm, attempt) with made; host, if they have it: the attempt of an address's domain."""
    k, norm, n = (F.col(c) for c in ("kind", "norm", "attempt"))
    host = F.col("host") if "host" in rows.columns else F.lit(0)
    step = F.transform(F.array(F.struct(_digest(secret, k, norm, n).alias("d"), F.when(k == "email", _digest(secret, F.lit("domain"), domain(norm), host)).alias("h"))), lambda x: surrogate(k, norm, x.d, n, x.h, host))
    return rows.withColumn("made", F.element_at(step, 1))


def _settled(found: DataFrame, secret: str) -> DataFrame:
    """(kind, norm, host, attempt) of found(kind, norm, host): attempts by which no surrogates collide."""
    now = common.written(_made(found.select("kind", "norm", "host", F.lit(0).alias("attempt")), secret), "entities")
    for turn in range(ROUNDS):
        first = now.groupBy("kind", "made").agg(F.min(F.struct("attempt", "norm")).alias("x"), F.count("*").alias("n"))
        shared = now.join(first.where("n > 1").select("kind", "made", F.col("x.norm").alias("kept")), ["kind", "made"]).where("norm <> kept").select("kind", "norm")
        real = now.join(now.select("kind", F.col("norm").alias("made")), ["kind", "made"], "left_semi").select("kind", "norm")
        bad = common.written(shared.unionByName(real).distinct().withColumn("bad", F.lit(1)), f"collisions{turn}")
        if bad.isEmpty():
            return now.select("kind", "norm", "host", "attempt")
        again = F.col("attempt") + F.coalesce("bad", F.lit(0))
        now = common.written(_made(now.join(bad, ["kind", "norm"], "left").select("kind", "norm", "host", again.alias("attempt")), secret), f"entities{turn}")
    raise RuntimeError("some kind of number has more members than surrogates")


def attempts(found: DataFrame, secret: str = SECRET) -> DataFrame:
    """(kind, norm, attempt) of the entities, domains among them, whose first surrogate collides. found(kind, norm)."""
    held = found.where("kind = 'email'").select(F.lit("domain").alias("kind"), domain(F.col("norm")).alias("norm")).distinct()
    hosts = _settled(held.withColumn("host", F.lit(0)), secret).where("attempt > 0")
    moved = hosts.select(F.lit("email").alias("kind"), F.col("norm").alias("held"), F.col("attempt").alias("host"))
    rest = found.withColumn("held", domain(F.col("norm"))).join(moved, ["kind", "held"], "left").select("kind", "norm", F.coalesce("host", F.lit(0)).alias("host"))
    return hosts.unionByName(_settled(rest, secret).where("attempt > 0")).select("kind", "norm", "attempt")


def _replaced(secret: str, attempt) -> Column:
    """The text with every mention replaced; attempt gives the attempt of (kind, norm)."""
    host = lambda norm: attempt(F.lit("domain"), domain(norm))
    step = F.transform(parsed(mentions(F.col("text"))), lambda x: F.struct(x.m.alias("m"), x.k.alias("k"), x.v.alias("v"), x.norm.alias("norm"), attempt(x.k, x.norm).alias("n"), host(x.norm).alias("hn")))
    step = F.transform(step, lambda x: F.struct(x.m.alias("m"), x.k.alias("k"), x.v.alias("v"), x.norm.alias("norm"), x.n.alias("n"), x.hn.alias("hn"), _digest(secret, x.k, x.norm, x.n).alias("d"), F.when(x.k == "email", _digest(secret, F.lit("domain"), domain(x.norm), x.hn)).alias("h")))
    step = F.transform(step, lambda x: F.struct(x.m.alias("m"), x.k.alias("k"), x.v.alias("v"), surrogate(x.k, x.norm, x.d, x.n, x.h, x.hn).alias("made")))
    made = F.transform(step, lambda x: laid_out(x.m, x.k, x.v, x.made))
    whole = F.array_join(F.zip_with(F.split("text", MENTION), made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.col("text").rlike(MENTION), whole).otherwise(F.col("text"))


def replaced(docs: DataFrame, secret: str = SECRET) -> DataFrame:
    """docs with surrogates in text, keyed by `secret`."""
    again = common.written(attempts(entities(docs), secret), "attempts")
    if again.isEmpty():
        return docs.withColumn("text", _replaced(secret, lambda k, n: F.lit(0)))
    # the texts that hold such an entity get the attempts of their own entities
    h, m, own_again = common.fresh(docs, "rw_h", "rw_m", "rw_again")
    of_text = parsed(mentions(F.col("text")))
    named = F.concat(F.transform(of_text, lambda x: F.struct(x.k.alias("kind"), x.norm.alias("norm"))), F.transform(F.filter(of_text, lambda x: x.k == "email"), lambda x: F.struct(F.lit("domain").alias("kind"), domain(x.norm).alias("norm"))))
    own = docs.select(F.xxhash64("text").alias(h), F.md5("text").alias(m), F.explode_outer(named).alias("x")).select(h, m, "x.kind", "x.norm").where("kind is not null").distinct()
    maps = own.join(again, ["kind", "norm"]).groupBy(h, m).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "norm"), "attempt"))).alias(own_again))
    both = docs.withColumns({h: F.xxhash64("text"), m: F.md5("text")}).join(maps, [h, m], "left")
    text = _replaced(secret, lambda k, n: F.coalesce(F.element_at(F.col(own_again), F.concat_ws("\x1f", k, n)), F.lit(0)))
    return both.withColumn("text", text).select(*docs.columns)


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_mentions, text) of all documents, with surrogates in text."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return replaced(docs.withColumn("n_mentions", F.coalesce(F.size(mentions(F.col("text"))), F.lit(0)).cast("int")))


QUERIES = {"op6_pii_surrogates": op6_pii_surrogates}
ORACLE: dict[str, str] = {}
