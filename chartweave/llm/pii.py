"""Personal data and secrets replaced by keyed surrogates of the same type and format.

A surrogate is drawn from a keyed digest of the value, so a value has one surrogate in all
documents.  Letters give letters of the same case, digits give digits; punctuation, country
codes, key prefixes and top-level domains stay; card numbers keep a valid check digit; names
keep their title, gender, script and number of parts.  A name's parts are drawn one by one, so
people who share a part share its surrogate, whatever is drawn again.  Distinct items (values, or
parts of names) are checked against each other: a surrogate that two items draw, or that is itself
an item of the corpus, goes to the smaller item or to none, and the others draw again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartweave.session import cut_lineage

# Titles by gender and script.
MALE = "Mr|Sir|Herr|Monsieur|Señor|Don|г-н|господин|κ|κύριος"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Señora|Doña|г-жа|госпожа|κα|κυρία"
NEUTRAL = "Dr|Prof|Dra|д-р"
# Syllables of surrogate names by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do ga ge ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te",
    "cyrillic": "ба бе би бо да де ди до га ге ка ке ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се та те",
    "greek": "βα βε βι βο δα δε δι δο γα γε κα κε λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε τα τε",
}

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}"
SECRET = r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b)[ ]?[=:][ ]?[\"']?[A-Za-z0-9+/_.-]{5,}[A-Za-z0-9+/_-]"
CLOUD_KEY = r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"
ACCOUNT = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (
    r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
    r"|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
)
NAME = rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
KINDS = (
    ("email", EMAIL),
    ("secret", SECRET),
    ("cloud_key", CLOUD_KEY),
    ("account", ACCOUNT),
    ("address", ADDRESS),
    ("card", CARD),
    ("social", SOCIAL),
    ("phone", PHONE),
    ("name", NAME),
)
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
#: What every match holds; tested first, as it is much cheaper.
HINT = rf"[0-9@]|AKIA|ASIA|(?i:password|passwd|pwd|secret|token|api)|(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}}"
DRAWS = 24
#: Draws after which a part of a name gets one syllable more.
SPARE_DRAWS = 4


def kind_of(value: Column) -> Column:
    out = None
    for name, pattern in KINDS:
        hit = value.rlike(rf"^(?:{pattern})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("secret")


def _fixed_part(value: Column, kind: Column) -> Column:
    """The beginning of a value that stays: keyword, key prefix, country code or title."""
    return (
        F.when(kind == "secret", F.regexp_extract(value, r"^[^=:]*[=:] ?[\"']?", 0))
        .when(kind == "cloud_key", F.substring(value, 1, 4))
        .when(kind == "account", F.substring(value, 1, 2))
        .when(kind == "card", F.substring(value, 1, 1))
        .when(kind == "phone", F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0))
        .when(kind == "name", F.regexp_extract(value, r"^[^ ]+ ", 0))
        .otherwise("")
    )


def _draw(digest: Column, place: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(digest, place), F.lit(n)).cast("int")


def _letter(alphabet: str, digest: Column, i: Column) -> Column:
    return F.substring(F.lit(alphabet), _draw(digest, i, len(alphabet)) + 1, F.lit(1))


def _same_shape(text: Column, digest: Column, hexadecimal: Column) -> Column:
    """Each letter and digit replaced by one of its class; hexadecimal text stays so."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def swap(c: Column, i: Column) -> Column:
        return (
            F.when(c.between("0", "9"), _letter("0123456789", digest, i))
            .when(c.between("a", "z") & hexadecimal, _letter("abcdef", digest, i))
            .when(c.between("a", "z"), _letter(lower, digest, i))
            .when(c.between("A", "Z"), _letter(upper, digest, i))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), swap), "")


def _check_digit(digits: Column) -> Column:
    """Luhn digit that makes ``digits`` followed by it valid."""
    n = F.length(digits)
    values = F.transform(
        F.split(digits, ""), lambda c, i: c.try_cast("int") * (1 + F.pmod(n - i, F.lit(2)))
    )
    total = F.aggregate(values, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _card(drawn: Column, value: Column) -> Column:
    """A drawn card number whose check digit is valid if the value's is."""
    old, new = F.regexp_replace(value, "[^0-9]", ""), F.regexp_replace(drawn, "[^0-9]", "")
    body = lambda digits: F.substring(digits, F.lit(1), F.length(digits) - 1)
    valid = F.substring(old, -1, 1) == _check_digit(body(old))
    return F.when(valid, F.concat(F.regexp_replace(drawn, r"[0-9]([^0-9]*)$", ""), _check_digit(body(new)))).otherwise(drawn)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name_part(word: Column, digest: Column, attempt: int) -> Column:
    """A made-up name of the word's script."""
    script, options = _script(word), None
    for name, text in SYLLABLES.items():
        given = F.split(F.lit(text), " ")
        options = F.when(script == name, given) if options is None else options.when(script == name, given)
    places = F.sequence(F.lit(0), F.lit(3 + attempt // SPARE_DRAWS))
    return F.initcap(F.array_join(F.transform(places, lambda k: F.element_at(options, _draw(digest, k, 32) + 1)), ""))


def _gender_ending(title: Column, word: Column) -> Column:
    """What shows the title's gender in a given name."""
    endings = {"latin": ("n", "na"), "cyrillic": ("н", "на"), "greek": ("ς", "να")}
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in endings.items() for x in (k, v[i])]), _script(word))
    bare = F.regexp_replace(title, r"[. ]+$", "")
    return F.when(bare.rlike(f"^(?:{MALE})$"), of(0)).when(bare.rlike(f"^(?:{FEMALE})$"), of(1)).otherwise("")


def _with(s: Column, old: str, **new: Column) -> Column:
    """A struct of the fields ``old`` of ``s`` and new ones."""
    return F.struct(*[s[f].alias(f) for f in old.split()], *[c.alias(f) for f, c in new.items()])


def entities(found: Column) -> Column:
    """``kind``, ``fixed`` and ``words`` of each value found: the words of a name, or the value itself.
    Steps are chained transforms, so that no step repeats the expression of another."""
    typed = F.transform(found, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    begun = F.transform(typed, lambda s: _with(s, "value kind", fixed=_fixed_part(s["value"], s["kind"])))
    rest = lambda s: F.substring(s["value"], F.length(s["fixed"]) + 1, F.length(s["value"]))
    words = lambda s: F.when(s["kind"] == "name", F.split(rest(s), " ")).otherwise(F.array(s["value"]))
    return F.transform(begun, lambda s: _with(s, "kind fixed", words=words(s)))


def items_of(entity: Column) -> Column:
    kind = F.when(entity["kind"] == "name", "part").otherwise(entity["kind"])
    return F.transform(entity["words"], lambda w: F.struct(kind.alias("kind"), w.alias("value")))


def drawn(items: Column, secret: str, attempt: int = 0) -> Column:
    """The surrogates that ``items``, structs of ``kind`` and ``value``, draw at an attempt."""
    digest = lambda s: F.sha2(F.concat_ws("|", F.lit(secret), s["kind"], s["value"], F.lit(str(attempt))), 256)
    top = lambda s: F.when(s["kind"] == "email", F.regexp_extract(s["value"], r"\.[A-Za-z]+$", 0)).otherwise("")
    fixed = lambda s: F.when(s["kind"] == "part", "").otherwise(_fixed_part(s["value"], s["kind"]))
    begun = F.transform(items, lambda s: _with(s, "kind value", digest=digest(s), fixed=fixed(s), top=top(s)))
    inner = lambda s: F.substring(
        s["value"], F.length(s["fixed"]) + 1, F.length(s["value"]) - F.length(s["fixed"]) - F.length(s["top"])
    )
    cut = F.transform(begun, lambda s: _with(s, "kind value digest fixed top", body=inner(s)))
    told = F.transform(cut, lambda s: _with(s, "kind value digest fixed top body", plain=s["body"].rlike("^[0-9a-f]+$")))
    shape = lambda s: F.concat(s["fixed"], _same_shape(s["body"], s["digest"], s["plain"]), s["top"])
    made = F.transform(told, lambda s: _with(s, "kind value digest", shaped=F.when(s["kind"] != "part", shape(s))))
    octets = lambda s: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_draw(s["digest"], i, 254) + 1).cast("string"))
    return F.transform(
        made,
        lambda s: F.when(s["kind"] == "part", _name_part(s["value"], s["digest"], attempt))
        .when(s["kind"] == "address", F.array_join(octets(s), "."))
        .when(s["kind"] == "card", _card(s["shaped"], s["value"]))
        .otherwise(s["shaped"]),
    )


def found(text: Column) -> Column:
    """All values in a text, in order, each as often as it stands there."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def assigned(items: DataFrame, secret: str) -> DataFrame:
    """``(kind, value, surrogate, attempt)`` for the distinct ``items (kind, value)``, no surrogate
    twice and none that is an item.  An item that stays without after ``DRAWS`` draws gets its last
    draw with a digest added, which gives up its format."""
    own = cut_lineage(items.distinct())
    draw = lambda attempt: F.element_at(drawn(F.array(F.struct("kind", "value")), secret, attempt), 1)
    done, waiting = None, own
    for attempt in range(DRAWS):
        tried = waiting.withColumn("surrogate", draw(attempt))
        free = tried.join(own.select(F.col("value").alias("surrogate")), "surrogate", "left_anti")
        if done is not None:
            free = free.join(done.select("surrogate"), "surrogate", "left_anti")
        won = free.groupBy("surrogate").agg(F.min(F.struct("value", "kind")).alias("i"))
        won = won.select("i.kind", "i.value", "surrogate", F.lit(attempt).alias("attempt"))
        done = cut_lineage(won if done is None else done.unionByName(won))
        waiting = cut_lineage(own.join(done.select("kind", "value"), ["kind", "value"], "left_anti"))
        if waiting.isEmpty():
            return done
    tail = F.sha2(F.concat_ws("|", F.lit(secret), "value"), 256)
    rest = waiting.select("kind", "value", F.concat(draw(DRAWS), F.lit("-"), tail).alias("surrogate"), F.lit(DRAWS).alias("attempt"))
    return done.unionByName(rest)


def pseudonymised(
    docs: DataFrame, secret: str, text_col: str = "text", count_col: str | None = "n_entities"
) -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and their number in ``count_col``, a column of that
    name being replaced (None: no number).  ``n_chars`` is left as it is.  Who knows ``secret`` can find values by trying them.

    A null text stays null with no entities, and so does a text without any.  Repeated rows
    get the same surrogates; all other columns are kept whatever their names, and no order or id is
    relied on.
    """
    text = F.col(text_col)
    keep = [c for c in docs.columns if c != count_col]
    counted = lambda n: [n.cast("long").alias(count_col)] if count_col else []
    has = F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))
    plain = docs.filter(~has).select(*keep, *counted(F.lit(0)))
    # The columns that stay travel as one struct, so no name of theirs meets one of ours.  Written
    # once: the patterns are searched for in each text a single time.
    marked = cut_lineage(
        docs.filter(has).select(
            F.struct(*[F.lit(None).alias(c) if c == text_col else F.col(c) for c in keep]).alias("row"),
            F.xxhash64(text).alias("key"),
            F.split(text, ANY, -1).alias("between"),
            entities(found(text)).alias("entities"),
        )
    )
    items = marked.select("key", F.explode(F.flatten(F.transform("entities", items_of))).alias("i")).select("key", "i.*")
    # First draws are made in place; only the items that had to draw again are looked up.
    odd = assigned(items.select("kind", "value"), secret).filter("attempt > 0")
    name = lambda kind, value: F.concat(kind, F.lit("|"), value)
    redrawn = (
        items.join(odd.select("kind", "value", "surrogate"), ["kind", "value"])
        .select("key", name(F.col("kind"), F.col("value")).alias("item"), "surrogate")
        .distinct()
        .groupBy("key")
        .agg(F.map_from_entries(F.collect_list(F.struct("item", "surrogate"))).alias("odd"))
    )
    joined = marked.join(redrawn, "key", "left")

    def composed(e: Column) -> Column:
        pairs = F.zip_with(
            e["items"],
            e["first"],
            lambda i, first: F.coalesce(F.element_at("odd", name(i["kind"], i["value"])), first),
        )
        ending = lambda i: F.when((i == 0) & (F.size(e["items"]) > 1), _gender_ending(e["fixed"], e["items"][0]["value"])).otherwise("")
        whole = F.concat(e["fixed"], F.array_join(F.transform(pairs, lambda w, i: F.concat(w, ending(i))), " "))
        return F.when(e["kind"] == "name", whole).otherwise(pairs[0])

    itemised = F.transform("entities", lambda e: _with(e, "kind fixed", items=items_of(e)))
    first = F.transform(itemised, lambda e: _with(e, "kind fixed items", first=drawn(e["items"], secret)))
    new = F.transform(first, composed)
    whole = F.array_join(
        F.flatten(F.zip_with("between", new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""
    )
    replaced = joined.select(
        *[whole.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in keep],
        *counted(F.size("entities")),
    )
    return plain.unionByName(replaced)
