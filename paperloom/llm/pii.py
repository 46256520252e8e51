"""Personal data: detected entities are replaced by keyed surrogates of the same type.

Detected: e-mail addresses, IPv4 addresses, card numbers, phone numbers, social security numbers, account numbers
(IBAN), and names after a title.  An entity is a type and a normalised value (lower case, digits only, one space), so
different spellings of one value are one entity and get one surrogate, written in the spelling's format: digits, letters,
case and separators stay in place.  Surrogates derive from a secret key, the entity and an attempt number by SHA-256.
They match in type and format: cards keep their first digit and a valid check digit if they had one, addresses have
octets from 1 to 254, names follow the gender of the title and the script of the name.

Distinctness: over the whole table the surrogates are compared with each other and with every detected value.  An entity
whose surrogate is taken, by a real value or by an entity that comes before it, draws again with the next attempt.
After ATTEMPTS draws, i.e. where a format has no room for all entities, the surrogate is made longer by the draw.

Rows: null texts stay null, texts without entities stay as they are, both without a shuffle; repeated rows get equal
results; every other column passes through unchanged, whatever its name.  Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import stored

ATTEMPTS = 6
_NAME = r"\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?"
_MALE = ("Mr", "Herr", "Monsieur", "Señor", "Signor", "Господин", "Κύριος")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Signora", "Госпожа", "Κυρία")
_TITLES = "|".join(sorted(_MALE + _FEMALE, key=lambda t: (-len(t), t)))
#: type, pattern; at one place the first that fits counts
PATTERNS = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("card", r"(?<![A-Za-z0-9-])\d{4}(?:[ -]?\d{4}){3}(?![A-Za-z0-9-])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)"),
    ("name", rf"(?<!\w)(?:{_TITLES})\.? {_NAME}"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: For texts without an at sign: all other entities start with a capital, a digit, "+" or "(".
NO_MAIL = r"(?=[\p{Lu}0-9+(])(?:" + "|".join(f"(?:{p})" for k, p in PATTERNS if k != "email") + ")"
#: Given names by script and gender, and syllables of surnames by script (fixed values).
GIVEN = {
    ("latin", "m"): "Adrian Bruno Carl Daniel Emil Felix Gustav Hugo Ivo Jonas Karim Leo Marco Nico Oscar Paul".split(),
    ("latin", "f"): "Anna Bella Clara Dora Elena Flora Greta Helga Irma Julia Katja Lena Mara Nina Olga Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан Юрий".split(),
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Юлия".split(),
    ("greek", "m"): "Άρης Γιώργος Δημήτρης Ηλίας Θωμάς Ιωάννης Κώστας Λουκάς Μάριος Νίκος Πέτρος Σπύρος Στέλιος Τάσος Φώτης Χρήστος".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ηλέκτρα Θεοδώρα Ιωάννα Κατερίνα Λυδία Μαρία Νίκη Ολυμπία Σοφία Χριστίνα".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke la le lo ma me mo na ne no pa pe ra re ro sa se ta te va".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до жа за зе ка ке ла ле ло ма ме мо на не но па пе ра ре ро са та".split(),
    "greek": "βα βε βο γα γε δα δε δο ζα θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε τα".split(),
}


def _kind(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS):
        out = F.when(raw.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _title(raw: str) -> str:
    return rf"regexp_extract({raw}, '^({_TITLES})', 1)"


def _norm() -> Column:
    """Normalised value of raw by kind; a name without its title."""
    digits = F.regexp_replace("raw", "[^0-9]", "")
    return (F.when(F.col("kind").isin("card", "ssn", "phone"), digits).when(F.col("kind") == "ip", F.col("raw"))
            .when(F.col("kind") == "iban", F.replace(F.col("raw"), F.lit(" ")))
            .when(F.col("kind") == "name", F.concat_ws("|", F.col("gender"), F.lower(F.regexp_replace("raw", rf"^(?:{_TITLES})\.? ", ""))))
            .otherwise(F.lower("raw")))


#: Replaces letters and digits of s by draws from the seed; r(i, m) below.
def _redraw(s: str, first: int = 0) -> str:
    draw = "pmod(xxhash64(seed, i), {})"
    return (f"array_join(transform(split({s}, ''), (c, i) -> case when i < {first} then c when c rlike '^[0-9]$' then cast({draw.format(10)} as string) "
            f"when c rlike '^[a-z]$' then char(97 + cast({draw.format(26)} as int)) when c rlike '^[A-Z]$' then char(65 + cast({draw.format(26)} as int)) else c end), '')")


def _luhn(s: str) -> str:
    """Sum that is divisible by ten for valid numbers."""
    return (f"aggregate(transform(reverse(split({s}, '')), (c, i) -> if(i % 2 = 0, cast(c as int), cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0))), 0, (a, x) -> a + x)")


def _card() -> str:
    body = f"left({_redraw('norm', 1)}, length(norm) - 1)"
    check = f"pmod(10 - {_luhn(f'concat({body}, 0)')} % 10, 10)"
    last = f"if({_luhn('norm')} % 10 = 0, {check}, pmod({check} + 1 + pmod(xxhash64(seed, -1), 9), 10))"
    return f"concat({body}, cast({last} as string))"


def _name() -> str:
    quote = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"
    pick = lambda xs, i: f"element_at({quote(xs)}, cast(pmod(xxhash64(seed, {i}), {len(xs)}) as int) + 1)"
    body = "substring_index(norm, '|', -1)"
    cases = []
    for script, test in (("cyrillic", r"\\p{IsCyrillic}"), ("greek", r"\\p{IsGreek}"), ("latin", ".")):
        surname = f"initcap(concat_ws('', transform(sequence(1, 3 + attempt), j -> {pick(SYLLABLES[script], 'j')})))"
        given = f"if(norm like 'f|%', {pick(GIVEN[script, 'f'], -1)}, {pick(GIVEN[script, 'm'], -1)})"
        cases.append(f"when {body} rlike '{test}' then if({body} like '% %', concat({given}, ' ', {surname}), {surname})")
    return f"case {' '.join(cases)} end"


SURROGATE = f"""
case kind
when 'email' then concat({_redraw("left(norm, length(norm) - length(substring_index(norm, '.', -1)) - 1)")}, '.', substring_index(norm, '.', -1))
when 'ip' then concat_ws('.', transform(sequence(1, 4), i -> cast(1 + pmod(xxhash64(seed, i), 254) as string)))
when 'card' then {_card()}
when 'iban' then {_redraw('norm', 2)}
when 'phone' then {_redraw('norm', 1)}
when 'ssn' then {_redraw('norm', 0)}
when 'name' then {_name()}
end
"""
#: Writes a surrogate in the format of raw: separators where raw has them, upper case where raw has it.
WRITTEN = rf"""
case
when kind in ('card', 'ssn', 'phone', 'iban') then concat(
  aggregate(split(raw, ''), named_struct('out', '', 'at', 1),
            (s, c) -> if(c rlike '^[0-9A-Za-z]$', named_struct('out', concat(s.out, substring(surrogate, s.at, 1)), 'at', s.at + 1),
                         named_struct('out', concat(s.out, c), 'at', s.at)), s -> s.out),
  substring(surrogate, length(norm) + 1))
when kind = 'email' and length(surrogate) = length(raw) then array_join(transform(split(raw, ''), (c, i) ->
  if(c rlike '^[A-Z]$', upper(substring(surrogate, i + 1, 1)), substring(surrogate, i + 1, 1))), '')
when kind = 'name' then concat(regexp_extract(raw, '^(?:{_TITLES})\\.? ', 0), surrogate)
else surrogate end
"""


def _draw(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    seeded = entities.withColumn("attempt", F.lit(attempt)).withColumn("seed", F.sha2(F.concat_ws("|", F.lit(key), "kind", "norm", "attempt"), 256))
    drawn = seeded.withColumn("surrogate", F.expr(SURROGATE))
    if attempt >= ATTEMPTS:
        digits = F.regexp_replace("seed", "[^0-9]", "")
        drawn = drawn.withColumn("surrogate", F.when(F.col("kind") == "email", F.concat(F.substring(digits, 1, 12), "surrogate")).otherwise(F.concat("surrogate", F.substring(digits, 1, 12))))
    return drawn.select("kind", "norm", "surrogate")


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities(kind, norm), distinct -> with surrogate: distinct within a kind, and no detected value."""
    taken = entities.select("kind", F.when(F.col("kind") == "name", F.substring_index("norm", "|", -1)).otherwise(F.col("norm")).alias("used"))
    used = F.when(F.col("kind") == "name", F.lower("surrogate")).otherwise(F.col("surrogate"))
    pending, done, attempt = entities, None, 0
    while True:
        drawn = _draw(pending, key, attempt).withColumn("used", used)
        first = drawn.groupBy("kind", "used").agg(F.min("norm").alias("norm"))
        good = first.join(taken, ["kind", "used"], "left_anti")
        judged = stored(drawn.join(good.withColumn("good", F.lit(True)), ["kind", "used", "norm"], "left"), "surrogates")
        won = judged.where("good").select("kind", "norm", "surrogate")
        done = won if done is None else done.union(won)
        pending = judged.where("good is null").select("kind", "norm")
        if pending.isEmpty():
            return done
        taken = taken.union(judged.where("good").select("kind", "used"))
        attempt += 1


def replace_entities(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with every detected entity of the text replaced; count names a column for their number."""
    columns, t = docs.columns, F.col(f"`{text}`")
    mail = t.contains("@")  # every entity holds an at sign, a digit or a title; most texts hold none
    other = t.rlike(rf"[0-9]|{_TITLES}")
    rows = docs.withColumn("_found", F.when(mail, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).when(other, F.regexp_extract_all(t, F.lit(NO_MAIL), F.lit(0))))
    hit = F.coalesce(F.size("_found") > 0, F.lit(False))
    number = [F.coalesce(F.size("_found"), F.lit(0)).cast("long").alias(count)] if count else []
    plain = rows.where(~hit).select(*[F.col(f"`{c}`") for c in columns], *[F.lit(0).cast("long").alias(c) for c in [count] if c])
    rows = stored(rows.where(hit).withColumn("_row", F.xxhash64(t)), "texts-with-entities")  # equal texts have equal entities
    raws = rows.select("_row", F.explode(F.array_distinct("_found")).alias("raw")).distinct()
    raws = raws.withColumn("kind", _kind(F.col("raw"))).withColumn("gender", F.expr(f"if({_title('raw')} in ({', '.join(repr(x) for x in _FEMALE)}), 'f', 'm')"))
    raws = stored(raws.withColumn("norm", _norm()).drop("gender"), "entities")
    surrogates = assign_surrogates(stored(raws.select("kind", "norm").distinct(), "entity-values"), key)
    written = raws.join(surrogates, ["kind", "norm"]).withColumn("written", F.expr(WRITTEN))
    maps = written.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("raw", "written"))).alias("_map"))
    rows = rows.join(maps, "_row")
    pieces = F.when(mail, F.split(t, ANY, -1)).otherwise(F.split(t, NO_MAIL, -1))
    filled = F.zip_with(pieces, F.col("_found"), lambda p, raw: F.concat(p, F.coalesce(F.element_at("_map", raw), F.lit(""))))
    changed = rows.withColumn(text, F.array_join(filled, "")).select(*[F.col(f"`{c}`") for c in columns], *number)
    return plain.union(changed)
