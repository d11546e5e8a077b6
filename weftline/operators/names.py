"""Similarity of column names: splitting, abbreviations, conflicts, and the scores that use them.

All are expressions; dictionaries are small fixed maps inside them. Score distinct names first and join back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "id": "identifier", "pk": "primary", "fk": "foreign", "ref": "reference", "cust": "customer", "usr": "user", "acct": "account", "acc": "account",
    "dept": "department", "org": "organization", "emp": "employee", "mgr": "manager", "mngr": "manager", "adm": "admin", "cfg": "configuration",
    "conf": "configuration", "param": "parameter", "attr": "attribute", "meta": "metadata", "db": "database", "tbl": "table", "col": "column",
    "idx": "index", "seq": "sequence", "repo": "repository", "amt": "amount", "bal": "balance", "qty": "quantity", "txn": "transaction",
    "inv": "invoice", "ord": "order", "pay": "payment", "prc": "price", "sal": "salary", "ship": "shipment", "addr": "address", "dest": "destination",
    "src": "source", "ts": "timestamp", "dt": "date", "tm": "time", "dob": "birthdate", "svc": "service", "api": "interface", "ctrl": "controller",
    "proc": "process", "exec": "execution", "cfgmgr": "configuration manager", "stat": "status", "sts": "status", "flg": "flag", "typ": "type",
    "grp": "group", "grpmap": "group mapping", "map": "mapping", "rel": "relation", "desc": "description", "msg": "message", "err": "error",
    "num": "number", "val": "value", "cnt": "count", "min": "minimum", "max": "maximum", "usd": "us dollar", "us$": "us dollar", "$": "us dollar",
    "eur": "euro", "€": "euro", "inr": "indian rupee", "₹": "indian rupee", "rs": "indian rupee", "gbp": "british pound sterling",
    "£": "british pound sterling", "jpy": "japanese yen", "¥": "japanese yen", "cny": "chinese yuan", "rmb": "chinese yuan", "aud": "australian dollar",
    "a$": "australian dollar", "cad": "canadian dollar", "c$": "canadian dollar", "chf": "swiss franc", "sgd": "singapore dollar", "s$": "singapore dollar",
    "hkd": "hong kong dollar", "hk$": "hong kong dollar", "nzd": "new zealand dollar", "sek": "swedish krona", "nok": "norwegian krone",
    "dkk": "danish krone", "zar": "south african rand", "rub": "russian ruble", "brl": "brazilian real", "mxn": "mexican peso", "krw": "south korean won",
    "₩": "south korean won", "try": "turkish lira", "aed": "uae dirham", "sar": "saudi riyal", "qar": "qatari riyal", "kwd": "kuwaiti dinar",
    "bhd": "bahraini dinar", "omr": "omani rial", "pkr": "pakistani rupee", "bdt": "bangladeshi taka", "lkr": "sri lankan rupee", "thb": "thai baht",
    "฿": "thai baht", "idr": "indonesian rupiah", "myr": "malaysian ringgit", "php": "philippine peso", "vnd": "vietnamese dong", "pln": "polish zloty",
    "czk": "czech koruna", "huf": "hungarian forint", "ils": "israeli shekel", "₪": "israeli shekel",
}
# Opposite words, by kind of conflict, with the kind's penalty.
DIRECTIONAL = (
    ("min", "max"), ("minimum", "maximum"), ("start", "end"), ("begin", "end"), ("from", "to"), ("low", "high"), ("lower", "upper"), ("first", "last"),
    ("left", "right"), ("top", "bottom"), ("front", "back"), ("before", "after"), ("previous", "next"), ("prev", "next"), ("above", "below"),
    ("ascending", "descending"), ("asc", "desc"), ("forward", "backward"), ("inner", "outer"), ("internal", "external"), ("north", "south"),
    ("east", "west"), ("head", "tail"), ("prefix", "suffix"), ("earliest", "latest"), ("newest", "oldest"), ("youngest", "eldest"),
    ("smallest", "largest"), ("shortest", "longest"), ("initial", "final"),
)
ROLES = (
    ("buyer", "seller"), ("sender", "receiver"), ("source", "target"), ("parent", "child"), ("input", "output"), ("credit", "debit"),
    ("employer", "employee"), ("lender", "borrower"), ("landlord", "tenant"), ("vendor", "customer"), ("supplier", "consumer"), ("author", "reader"),
    ("teacher", "student"), ("doctor", "patient"), ("server", "client"), ("host", "guest"), ("master", "slave"), ("primary", "secondary"),
    ("principal", "agent"), ("domestic", "international"), ("wholesale", "retail"), ("inbound", "outbound"),
)
TEMPORAL = (
    ("created", "deleted"), ("created", "updated"), ("inserted", "removed"), ("active", "inactive"), ("open", "closed"), ("enabled", "disabled"),
    ("started", "stopped"), ("started", "finished"), ("started", "completed"), ("pending", "completed"), ("pending", "cancelled"),
    ("approved", "rejected"), ("locked", "unlocked"), ("subscribed", "unsubscribed"), ("enrolled", "withdrawn"), ("hired", "terminated"),
    ("born", "deceased"), ("birth", "death"), ("login", "logout"), ("checkin", "checkout"), ("entry", "exit"),
)
UNIT_GROUPS = (
    ("usd", "inr", "eur", "gbp", "jpy", "aud", "cad", "chf", "sgd", "hkd", "nzd", "sek", "nok", "dkk", "zar", "rub", "brl", "mxn", "krw", "try", "aed", "sar", "dollar", "pound", "rupee", "yen", "yuan", "euro"),
    ("kg", "kilogram", "gram", "g", "lb", "oz", "ounce", "ton", "tonne"),
    ("km", "kilometer", "mile", "mi", "meter", "m", "ft", "foot", "inch", "in", "yard", "yd", "cm", "mm"),
    ("sec", "second", "ms", "millisecond", "minute", "min", "hour", "hr", "day", "week", "month", "year"),
    ("c", "celsius", "f", "fahrenheit", "kelvin", "k"),
    ("byte", "kb", "mb", "gb", "tb", "pb", "kilobyte", "megabyte", "gigabyte", "terabyte"),
    ("watt", "kw", "kilowatt", "mw", "megawatt", "hp", "horsepower"),
    ("liter", "litre", "gallon", "gal", "ml", "milliliter", "pint", "quart", "cup"),
)
UNITS = tuple(u for group in UNIT_GROUPS for u in group)
PENALTIES = {"directional": 0.45, "role": 0.40, "temporal": 0.35, "unit": 0.50}
PAIRS = {"directional": DIRECTIONAL, "role": ROLES, "temporal": TEMPORAL}
# Words for the same thing in names.
SYNONYMS = {
    "emp": ["employee", "empl"], "employee": ["emp", "empl"], "dept": ["department", "dep"], "department": ["dept", "dep"], "mgr": ["manager"],
    "manager": ["mgr"], "addr": ["address"], "address": ["addr"], "num": ["number", "no"], "qty": ["quantity"], "amt": ["amount"], "amount": ["amt"],
    "desc": ["description"], "cat": ["category"], "org": ["organization", "organisation"], "loc": ["location"], "location": ["loc"],
    "tel": ["telephone", "phone"], "proj": ["project"], "project": ["proj"], "cust": ["customer"], "customer": ["cust"], "prod": ["product"],
    "product": ["prod"], "txn": ["transaction"], "acct": ["account"], "account": ["acct"], "fname": ["first", "name", "firstname"], "lname": ["last", "name", "lastname"],
    "dob": ["date", "of", "birth"], "title": ["name", "label"], "key": ["id", "pk", "identifier"], "id": ["key", "identifier"],
    "owning": ["owner", "owns"], "annual": ["yearly", "year"], "salary": ["pay", "compensation", "wage"],
}


def _map(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])


def words(name: Column) -> Column:
    """Words of a name: separators and changes of case or to digits part them."""
    parts = F.regexp_extract_all(F.regexp_replace(name, "[_-]", " "), F.lit("[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0))
    return F.transform(parts, F.lower)


def simple_tokens(name: Column) -> Column:
    """Lower-case runs of letters and digits, camel case parted first."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, "[^A-Za-z0-9]+", " ")), " "), lambda t: t != "")


def expand(tokens: Column) -> Column:
    """Abbreviations replaced by what they stand for; a phrase becomes several tokens."""
    known = _map(ABBREVIATIONS)
    return F.flatten(F.transform(tokens, lambda t: F.split(F.coalesce(F.try_element_at(known, t), t), " ")))


def known_words(more: dict[str, float] | None = None) -> dict[str, float]:
    """Words that names are cut into, each with its cost: those of this module's tables, the longer the cheaper, and more."""
    told = [*ABBREVIATIONS, *ABBREVIATIONS.values(), *SYNONYMS, *[w for pairs in PAIRS.values() for p in pairs for w in p]]
    usable = lambda phrases: {w for phrase in phrases for w in phrase.split(" ") if w.isalpha() and len(w) > 1}
    found, others = usable(told), usable(w for vs in SYNONYMS.values() for w in vs)
    # a synonym that is two of the words run together is no word of its own
    found |= {w for w in others if not any(w[:i] in found | others and w[i:] in found | others for i in range(3, len(w) - 2))}
    return {w: 1 + 6 / len(w) for w in found} | (more or {})


def weighed_words(words: DataFrame, most: int = 20_000) -> dict[str, float]:
    """Costs of the most frequent words of a column word: minus the logarithm of each word's share, at most that many words."""
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    return {r.word: math.log(total / r.n) for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()}


def segment(token: Column, words: dict[str, float] | None = None, least: int = 2) -> Column:
    """A token cut into words: the cheapest cut by dynamic programming over its places, of equals the first by its parts.

    A known word is never cut. What no word covers stays as a part of its own and costs 3 and 1.5 for each letter; parts
    of fewer letters than least are not allowed, so a token that would need one stays whole.
    """
    words = known_words() if words is None else words
    costs, longest = _map(words), max(map(len, words), default=1)
    never = F.lit(1e6)

    def cost(part: Column) -> Column:
        n = F.char_length(part)
        return F.when(n < least, never).otherwise(F.coalesce(F.try_element_at(costs, part), 3 + 1.5 * n))

    def best(done: Column, end: Column) -> Column:
        # words are at most longest letters long; what no word covers may be longer, up to the whole token
        starts = F.sequence(F.lit(0), end - 1)
        near = F.filter(starts, lambda j: (end - j <= longest) | (j == 0) | (end == F.char_length(token)))
        return F.array_min(F.transform(near, lambda j: F.struct(
            (F.get(done, j)["cost"] + cost(F.substring(token, j + 1, end - j))).alias("cost"), F.array_append(F.get(done, j)["parts"], F.substring(token, j + 1, end - j)).alias("parts"))))

    begun = F.array(F.struct(F.lit(0.0).alias("cost"), F.array().cast("array<string>").alias("parts")))
    done = F.aggregate(F.sequence(F.lit(1), F.char_length(token)), begun, lambda acc, i: F.array_append(acc, best(acc, i)), lambda acc: F.element_at(acc, -1))
    whole = F.array(token)
    cut = F.when(done["cost"] < never, done["parts"]).otherwise(whole)
    return F.when(F.coalesce(token, F.lit("")) == "", F.array().cast("array<string>")).when(F.try_element_at(costs, token).isNotNull() | (F.char_length(token) < 2 * least), whole).otherwise(cut)


def meaning(name: Column, vocabulary: dict[str, float] | None = None, expander=None) -> Column:
    """The whole pipeline of a name: split by its form, cut into words, abbreviations expanded.

    expander, if given, maps a word that the dictionary does not have to another, as a model would; it is asked only for
    words that are not known, and its answer is taken if it has three letters or more.
    """
    parts = F.flatten(F.transform(words(name), lambda t: segment(t, vocabulary)))
    told = expand(parts)
    if expander is None:
        return told
    known = _map(known_words() | (vocabulary or {}))

    def asked(t: Column) -> Column:
        other = expander(t)
        return F.when(F.try_element_at(known, t).isNotNull() | (F.char_length(F.coalesce(other, F.lit(""))) < 3), t).otherwise(other)

    return F.transform(told, asked)


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def _any_opposite(a: Column, b: Column, known: Column) -> Column:
    return F.exists(a, lambda t: F.coalesce(F.arrays_overlap(F.try_element_at(known, t), b), F.lit(False)))


def conflicts(a: Column, b: Column) -> Column:
    """Kinds of conflict between two token arrays, sorted."""
    found = []
    for kind, pairs in PAIRS.items():
        opposite = {}
        for x, y in pairs:
            opposite.setdefault(x, []).append(y)
            opposite.setdefault(y, []).append(x)
        found.append(F.when(_any_opposite(a, b, _map(opposite)), kind))
    units = F.array(*map(F.lit, UNITS))
    ua, ub = F.array_intersect(a, units), F.array_intersect(b, units)
    # any two different units conflict, of the same group or not; a unit and what it stands for are no conflict
    differ = (F.size(F.array_except(ua, ub)) > 0) & (F.size(F.array_except(ub, ua)) > 0)
    found.append(F.when(differ, "unit"))
    return F.array_sort(F.array_compact(F.array(*found)))


def conflict_penalty(a: Column, b: Column) -> Column:
    weights = _map(PENALTIES)
    return F.least(F.lit(1.0), F.aggregate(conflicts(a, b), F.lit(0.0), lambda s, k: s + F.try_element_at(weights, k)))


def name_similarity(a: Column, b: Column, base: Column | None = None) -> Column:
    """Base similarity (a model's cosine, or the Jaccard of expanded words) less the conflict penalty."""
    ta, tb = expand(words(a)), expand(words(b))
    return (jaccard(F.array_distinct(ta), F.array_distinct(tb)) if base is None else base) * (1 - conflict_penalty(F.array_union(ta, words(a)), F.array_union(tb, words(b))))


def confidence(score: Column) -> Column:
    return F.when(score > 0.85, "HIGH").when(score > 0.65, "MEDIUM").otherwise("LOW")


def id_like(name: Column) -> Column:
    return F.lower(name).endswith("id")


def stem(name: Column) -> Column:
    """The name without its ending id."""
    low = F.lower(name)
    cut = F.when(low.endswith("_id"), F.left(low, F.char_length(low) - 3)).when(low.endswith("id") & (F.char_length(low) > 2), F.left(low, F.char_length(low) - 2)).otherwise(low)
    return F.btrim(cut, F.lit("_"))


def _plain_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != ""))


def join_name_score(a: Column, b: Column) -> Column:
    """For joins: equal 1, equal without underscores .95, ids of related stems .88, other ids .48, else token Jaccard."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    bare = lambda c: F.replace(c, F.lit("_"), F.lit(""))
    sx, sy = stem(x), stem(y)
    related = (sx != "") & (sy != "") & (F.contains(sx, sy) | F.contains(sy, sx))
    tokens = jaccard(_plain_tokens(a), _plain_tokens(b))
    return F.when(x == y, 1.0).when(bare(x) == bare(y), 0.95).when(id_like(x) & id_like(y), F.when(related, 0.88).otherwise(0.48)).otherwise(tokens)


def lexical_similarity(a: Column, b: Column) -> Column:
    """The larger of token Jaccard and a blend of Jaccard, containment, character trigrams and being a part."""
    ta, tb = F.array_distinct(simple_tokens(a)), F.array_distinct(simple_tokens(b))
    jac = jaccard(ta, tb)
    contained = F.coalesce(F.try_divide(F.size(F.array_intersect(ta, tb)), F.least(F.size(ta), F.size(tb))), F.lit(0.0))
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(F.array_join(t, "")) - 2)), lambda i: F.substring(F.array_join(t, ""), i, F.lit(3)))
    part = F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))
    return F.greatest(jac, 0.40 * jac + 0.25 * contained + 0.20 * jaccard(F.array_distinct(grams(ta)), F.array_distinct(grams(tb))) + 0.15 * F.when(part, 0.15).otherwise(0.0))


def _stemmed(t: Column) -> Column:
    return F.when(t.endswith("ies"), F.concat(F.left(t, F.char_length(t) - 3), F.lit("y"))).when(t.rlike("(ses|xes)$"), F.left(t, F.char_length(t) - 2)).when(t.endswith("s") & ~t.endswith("ss"), F.left(t, F.char_length(t) - 1)).otherwise(t)


def _synonymous(tokens: Column) -> Column:
    """Tokens with their stems, synonyms, and the keys that name them as synonyms."""
    known = _map(SYNONYMS)
    back: dict[str, list[str]] = {}
    for k, vs in SYNONYMS.items():
        for v in vs:
            back.setdefault(v, []).append(k)
    backward = _map(back)
    all_tokens = F.array_union(tokens, F.transform(tokens, _stemmed))
    empty = F.array().cast("array<string>")
    more = F.flatten(F.transform(all_tokens, lambda t: F.concat(F.coalesce(F.try_element_at(known, t), empty), F.coalesce(F.try_element_at(backward, t), empty))))
    return F.array_union(all_tokens, more)


def bridge_similarity(a: Column, b: Column) -> Column:
    """For mapping: the larger of plain and synonym-expanded Jaccard, with .3 more if one name is part of the other."""
    ta, tb = F.array_distinct(simple_tokens(a)), F.array_distinct(simple_tokens(b))
    bare = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(""))
    part = F.contains(bare(a), bare(b)) | F.contains(bare(b), bare(a))
    return F.least(F.lit(1.0), F.greatest(jaccard(ta, tb), jaccard(_synonymous(ta), _synonymous(tb))) + F.when(part, 0.3).otherwise(0.0))
