"""Personal data replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgene.llm.graph import kept

# What is detected, in order of precedence, and the lead of a match that stays (titles and secret names).
MALE = "Mr|Herr|Monsieur|Señor|Sr|Sir|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Sra|Госпожа|Κυρία"
SECRETS, ACCESS = "password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key", "AKIA"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": rf"(?i:\b(?:{SECRETS})\b[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?)[A-Za-z0-9_\-+/=.~]{{7,}}[A-Za-z0-9_\-+/=~]|\b{ACCESS}[0-9A-Z]{{16}}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<!\d)\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+?\d{0,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "name": rf"\b(?:{MALE}|{FEMALE})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?",
}
#: What every match of any pattern has in it: a digit, an @, the name of a secret, the beginning of an access key or a title.
TRIGGER = rf"[0-9@]|(?i:{SECRETS})|{ACCESS}|\b(?:{MALE}|{FEMALE})\.? "
LEAD = rf"^((?i:(?:{SECRETS})[\"']?\s*[=:]\s*[\"']?)|{ACCESS}(?=[0-9A-Z]{{16}}$)|(?:{MALE}|{FEMALE})\.? )?(.*)$"
# Given names by script and gender, and syllables that surnames are made of.
GIVEN = {
    ("latin", "f"): "Ada Beth Clara Dora Edith Flora Grace Helen Irma Jane Karin Laura Mara Nora Olga Paula Rita Sonja Tina Vera".split(),
    ("latin", "m"): "Alan Boris Carl David Emil Frank Georg Henry Ivan Jonas Karl Leon Martin Nils Otto Paul Ralph Simon Tom Victor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Мария Нина Ольга".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Олег".split(),
    ("greek", "f"): "Άννα Βέρα Δάφνη Ειρήνη Ζωή Ελένη Ιωάννα Μαρία Νίκη Σοφία".split(),
    ("greek", "m"): "Άρης Γιώργος Δήμος Ηλίας Κώστας Λουκάς Μάρκος Νίκος Πέτρος Σπύρος".split(),
}
SYLLABLES = {
    "latin": "bal ber dan del fen gar hol kan kel lan lor mar mel nor pel ran sel tor val ven wil zan".split(),
    "cyrillic": "бал бер вол гор дан зор кал лан мар мел нов пет рог сел тар фил".split(),
    "greek": "βαλ γαρ δελ ζαν καλ λορ μαρ νερ παλ ραν σελ τορ φιλ χαν".split(),
}
ANY = "|".join(PATTERNS.values())
#: Attempts that keep the format exactly; a later one adds a keyed tail, so that search always ends.
STRICT_ATTEMPTS = 12


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once and written once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pick(options: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


def parsed(match: Column) -> Column:
    """A match as struct(kind, lead, core, gender): its type is the first pattern that fits all of it, ``core`` identifies the entity."""
    kind = F.coalesce(*[F.when(match.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()])
    lead = F.regexp_extract(match, LEAD, 1)
    gender = F.when(lead.rlike(f"^(?:{FEMALE})\\.? $"), "f").when(lead.rlike(f"^(?:{MALE})\\.? $"), "m").otherwise("")
    return F.struct(kind.alias("kind"), lead.alias("lead"), F.regexp_extract(match, LEAD, 2).alias("core"), gender.alias("gender"))


def _stream(secret: str, *parts: Column) -> Column:
    """128 keyed hex digits."""
    return F.sha2(F.concat_ws("\u0001", F.lit(secret), *[p.cast("string") for p in parts]), 512)


def _number(stream: Column, at: int | Column, digits: int = 4) -> Column:
    return F.conv(F.substr(stream, F.lit(at) if isinstance(at, int) else at, F.lit(digits)), 16, 10).cast("long")


def _letter(first: str, n: Column) -> Column:
    return F.char(F.lit(ord(first)) + n)


def scrambled(text: Column, stream: Column) -> Column:
    """Every ASCII digit and letter replaced by a keyed one of its class and case, all else kept; hex stays hex."""
    letters = F.when(text.rlike("^[0-9a-f]+$"), 6).otherwise(26)

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, F.pmod(i * 4, F.lit(124)) + 1)
        return (
            F.when(c.rlike("[0-9]"), _letter("0", F.pmod(n, F.lit(10))))
            .when(c.rlike("[a-z]"), _letter("a", F.pmod(n, letters)))
            .when(c.rlike("[A-Z]"), _letter("A", F.pmod(n, F.lit(26)))).otherwise(c)
        )

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits, the last one not doubled."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _card(core: Column, stream: Column) -> Column:
    """First digit and separators kept; a number that passes Luhn's test still does."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    valid = _let(digits(core), lambda d: luhn_sum(d) % 10 == 0)

    def checked(drawn: Column) -> Column:
        open_end = F.regexp_replace(digits(drawn), "[0-9]$", "0")
        check = F.pmod(10 - _let(open_end, luhn_sum) % 10, F.lit(10)).cast("string")
        return F.when(valid, F.concat(F.substr(drawn, F.lit(1), F.length(drawn) - 1), check)).otherwise(drawn)

    return _let(F.concat(F.substring(core, 1, 1), scrambled(F.substr(core, F.lit(2)), stream)), checked)


DOMAIN = r"@(.*)\.[^.@]+$"


def _email(core: Column, stream: Column, domain_stream: Column) -> Column:
    """Local part by the address, domain by the domain alone, so that colleagues stay colleagues; the last label stays."""
    local, domain = F.regexp_extract(core, "^(.*)@", 1), F.regexp_extract(core, DOMAIN, 1)
    return F.concat(scrambled(local, stream), F.lit("@"), scrambled(domain, domain_stream), F.regexp_extract(core, r"(\.[^.]+)$", 1))


def _ip(stream: Column) -> Column:
    return F.concat_ws(".", *[(F.pmod(_number(stream, 1 + 4 * i), F.lit(254)) + 1).cast("string") for i in range(4)])


def _iban(core: Column, stream: Column) -> Column:
    return F.concat(F.substring(core, 1, 2), scrambled(F.substr(core, F.lit(3)), stream))


def _name(core: Column, gender: Column, stream: Column) -> Column:
    def of(script: Column) -> Column:
        given, surname = F.lit(""), F.lit("")
        for kind, syllables in SYLLABLES.items():
            made = F.concat(*[_pick(syllables, _number(stream, 9 + 4 * i)) for i in range(4)])
            surname = F.when(script == kind, F.initcap(made)).otherwise(surname)
            for sex in "mf":
                given = F.when((script == kind) & (gender == sex), _pick(GIVEN[kind, sex], _number(stream, 1))).otherwise(given)
        return F.when(core.contains(" "), F.concat(given, F.lit(" "), surname)).otherwise(surname)

    script = F.when(core.rlike(r"\p{IsCyrillic}"), "cyrillic").when(core.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    return _let(_let(script, of), lambda whole: F.when((core == F.upper(core)) & (F.length(core) > 1), F.upper(whole)).otherwise(whole))


def _phone(core: Column, stream: Column) -> Column:
    """Country code and layout kept."""
    code = F.regexp_extract(core, r"^(\+\d{1,3}(?=[ .(-]))?", 1)
    return F.concat(code, scrambled(F.substr(core, F.length(code) + 1), stream))


def surrogates(found: Column, secret: str) -> Column:
    """``found``, an array of struct(kind, lead, core, gender, attempt), as struct(kind, lead, surrogate): keyed functions of
    type, identity, gender and attempt alone, the same in every document."""
    keyed = F.transform(found, lambda x: F.struct(
        *[x[c].alias(c) for c in ("kind", "lead", "core", "gender", "attempt")], _stream(secret, x["kind"], x["core"], x["gender"], x["attempt"]).alias("stream"),
        _stream(secret, F.lit("domain"), F.regexp_extract(x["core"], DOMAIN, 1)).alias("domain"),
    ))

    def made(x: Column) -> Column:
        kind, core, stream = x["kind"], x["core"], x["stream"]
        new = (
            F.when(kind == "email", _email(core, stream, x["domain"])).when(kind == "ip", _ip(stream)).when(kind == "card", _card(core, stream))
            .when(kind == "iban", _iban(core, stream)).when(kind == "name", _name(core, x["gender"], stream)).when(kind == "phone", _phone(core, stream))
            .otherwise(scrambled(core, stream))
        )
        tail = F.when(x["attempt"] < STRICT_ATTEMPTS, "").otherwise(F.substring(stream, 1, 16))
        return F.struct(kind.alias("kind"), x["lead"].alias("lead"), F.when(kind == "email", F.concat(tail, new)).otherwise(F.concat(new, tail)).alias("surrogate"))

    return F.transform(keyed, made)


def matches(text: Column) -> Column:
    """Matches in order; texts without a TRIGGER are not searched. Null gives an empty array."""
    return F.when(text.rlike(TRIGGER), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def found_in(text: Column) -> Column:
    return F.transform(matches(text), parsed)


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, core, gender) over all documents."""
    found = docs.select(F.explode(found_in(F.col(text))).alias("m"))
    return found.select("m.kind", "m.core", "m.gender").distinct()


def _drawn(tried: DataFrame, secret: str) -> DataFrame:
    """(kind, core, gender, attempt, s), written: the draws are made once, over all tasks and not as many as the bytes would ask for."""
    one = F.array(F.struct("kind", F.lit("").alias("lead"), "core", "gender", "attempt"))
    parts = int(tried.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(tried.repartition(parts, "kind", "core", "gender").withColumn("s", F.element_at(surrogates(one, secret), 1)["surrogate"]), "drawn")


def collisions(found: DataFrame, secret: str) -> DataFrame:
    """(kind, core, gender, attempt) of entities whose first surrogate is another entity's too, or is a real entity.

    In each round those that collide, all but the smallest of a surrogate, draw again, until surrogates are distinct and
    none of them occurs in the corpus. Each round is two aggregations over the table of distinct entities, and draws for those that collide.
    """
    identity = ["kind", "core", "gender"]
    drawn = _drawn(found.withColumn("attempt", F.lit(0)), secret)
    real = drawn.select("kind", F.col("core").alias("s")).distinct().withColumn("real", F.lit(True))
    while True:
        first = drawn.groupBy("kind", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "core", "gender")).alias("owner"))
        bad = first.join(real, ["kind", "s"], "left").where((F.col("n") > 1) | F.col("real"))
        again = drawn.join(bad, ["kind", "s"]).where(F.col("real") | (F.struct("attempt", "core", "gender") != F.col("owner")))
        again = kept(again.select(*identity, (F.col("attempt") + 1).alias("attempt")), "collisions")
        if again.isEmpty():
            return drawn.where("attempt > 0").select(*identity, "attempt")
        drawn = kept(drawn.join(again, identity, "left_anti").select(*identity, "attempt", "s").unionByName(_drawn(again, secret)), "drawn")


def _name_of(m: Column) -> Column:
    return F.concat_ws("\u0001", m["kind"], m["core"], m["gender"])


def replace_all(docs: DataFrame, *, secret: str = "tallgene", text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and a column ``entities`` (array of kind and surrogate, in order).

    An entity (address, number, name, secret) gets the same surrogate wherever it occurs and two entities never share one:
    the surrogate is a keyed function of the entity alone, and the few entities that collide over the whole corpus draw
    again. Titles and names of secrets stay; names keep gender and script, numbers their layout, valid cards stay valid.
    Texts without matches, empty and null ones are unchanged with an empty array. Rows, also repeated ones, and other columns stay;
    a column of the name ``entities`` is replaced. DataFrame functions only: one narrow pass rewrites the texts, and only when
    there are collisions the texts that hold them are joined by their hash.
    """
    moved = collisions(kept(entities(docs, text), "entities"), secret)
    whole = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), found_in(F.col(text)).alias("found"))
    if moved.isEmpty():
        attempt = lambda m: F.lit(0)
    else:
        touched = docs.select(F.sha2(F.col(text), 256).alias("sha"), F.explode(found_in(F.col(text))).alias("m")).select("sha", _name_of(F.col("m")).alias("name")).distinct()
        moves = moved.select(F.concat_ws("\u0001", "kind", "core", "gender").alias("name"), "attempt")
        maps = touched.join(moves, "name").groupBy("sha").agg(F.map_from_entries(F.collect_list(F.struct("name", "attempt"))).alias("moved"))
        whole = whole.withColumn("sha", F.sha2("text", 256)).join(maps, "sha", "left")
        attempt = lambda m: F.coalesce(F.element_at(F.col("moved"), _name_of(m)), F.lit(0))
    tried = F.transform("found", lambda m: F.struct(*[m[c].alias(c) for c in ("kind", "lead", "core", "gender")], attempt(m).alias("attempt")))
    whole = whole.withColumn("made", surrogates(tried, secret))
    tails = F.transform("made", lambda x: F.concat(x["lead"], x["surrogate"]))
    rebuilt = F.array_join(F.zip_with(F.split("text", ANY, -1), tails, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    shown = F.transform("made", lambda x: F.struct(x["kind"].alias("kind"), x["surrogate"].alias("surrogate")))
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (text, "entities")]
    return whole.select(*others, F.when(F.size("made") > 0, rebuilt).otherwise(F.col("text")).alias(text), shown.alias("entities"))
