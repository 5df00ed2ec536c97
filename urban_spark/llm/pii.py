"""Personal data and secrets in texts: fixed patterns, and spans that labelers agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urban_spark.llm.rules import accuracies
from urban_spark.llm.shared import cut, free

_LOCAL = "A-Za-z0-9._%+-"
#: kind -> pattern. An address starts where a run of its characters does, or where the match before ended: elsewhere in
#: a run no match starts, and trying would take quadratic time. Of digit chains only those of twelve digits or more are
#: matched, from where a chain starts: shorter ones fail anyway. What repeats does so possessively, which changes no match
#: here and needs no stack that grows with the text.
KINDS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters of context before and after a candidate, at most; it ends at the candidate beside it.
CONTEXT = 32
#: Buckets of hashed n-grams and context words, for each kind.
BUCKETS = 2048

_CODE = "A-Za-z0-9_+/"
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
SECRET_WORDS = "password|passwd|passphrase|pwd|token|secret|credential|apikey|api_key|api key|access key|access_key|private key|auth|bearer|login|pin"
OTHER_WORDS = "license|licence|version|isbn|issn|doi|http|www|page|chapter|figure|copyright|order|invoice|model|part|serial"
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Madam|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Don|Doña"
PARTICLES = "van|von|de|da|di|del|der|den|la|le|bin|al"
#: Common given names, fixed values.
GIVEN_NAMES = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Mark|Paul|Steven|Andrew|George|Kevin|Brian|Edward|Peter|Henry|Jack|Samuel|Benjamin|Alexander|Adam|"
    "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Lisa|Margaret|Sandra|Ashley|Emily|Donna|Michelle|Laura|Amanda|Emma|Olivia|Sophie|Alice|Anna|Julia|Jane|"
    "Hans|Klaus|Jürgen|Wolfgang|Dieter|Stefan|Andreas|Matthias|Lukas|Jonas|Ursula|Monika|Petra|Sabine|Heike|Katharina|"
    "Jean|Pierre|Michel|Philippe|Alain|Nicolas|Luc|Marie|Nathalie|Isabelle|Sylvie|Catherine|Camille|Chloé|"
    "José|Juan|Luis|Carlos|Jorge|Pedro|Miguel|Javier|Antonio|Francisco|María|Carmen|Ana|Lucía|Elena|Isabel|Rosa|"
    "Mohammed|Ahmed|Ali|Omar|Fatima|Aisha|Wei|Li|Yuki|Hiroshi|Priya|Raj|Amit|Ivan|Olga|Giulia|Marco"
)
NOT_NAMES = "January|February|March|April|May|June|July|August|September|October|November|December|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|The|This|That|New|North|South|East|West|United|University|Street|Road|Avenue|Company|Inc|Ltd|GmbH|Corporation|Institute|Department|Center|Centre|City|County|River|Lake|Mount|Chapter|Section|Figure|Table"
NAME_CUES = "name|names|called|dear|hello|hi|signed|author|contact|sincerely|regards|by|nombre|llamo|nom|appelle|heiße|heisse|patient|customer|employee|owner"
_LEAD = r"(?:Names?|Called|Dear|Hello|Hi|Signed|Author|Contact|Sincerely|Regards|By|From|To|And|Patient|Customer|Employee|Owner)\b"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Way|Terrace|Place"
STREETS_FIRST = "[Rr]ue|[Cc]alle|[Aa]venida|[Aa]venue|[Pp]laza|[Vv]ia|[Rr]ua|[Bb]oulevard"
STREETS_JOINED = "straße|strasse|str\\.|weg|platz|gasse|allee"
ADDRESS_CUES = "address|adresse|dirección|domicilio|lives|live|living|resides|wohnt|wohnhaft|habite|located|ship|deliver|home|office|at"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
BIRTH_WORDS = "born|birth|birthday|birthdate|dob|d\\.o\\.b|geboren|geburtstag|geburtsdatum|née?|naissance|nacid[oa]|nacimiento"
ACCOUNT_WORDS = "iban|ssn|social security|account|konto|compte|cuenta|passport|pasaporte|reisepass|passeport|dni|nif|tax id|tax|steuer|national id|identity|driver|licence number|license number|insurance"

_ASSIGNED = rf"[:=](?<=(?i:(?<![A-Za-z])(?:{SECRET_WORDS}))[\"']?[ \t]{{0,4}}[:=])[ \t]{{0,4}}"
_TAIL = lambda words: f"(?:{words})[^\\\\p{{L}}\\\\p{{N}}]*$"
#: kind -> patterns of candidates; a group 1, where a pattern has one, is what goes before the span itself. A pattern
#: begins with what few characters pass, so that the rest is seldom tried.
CANDIDATES = {
    "secret": [
        rf"(?<![{_CODE}])(?=[A-Za-z_+/]*[0-9])[{_CODE}]{{12,}}+",
        rf"(?=[Aspgrx])(?<![{_CODE}])(?:(?:AKIA|ASIA|AGPA|AROA)[0-9A-Z]{{16}}+(?![{_CODE}])|(?:sk|pk|rk|ghp|gho|ghs|xox[abp]|glpat)[_-][A-Za-z0-9_-]{{10,}}+)",
        rf"({_ASSIGNED}[\"'])[^\s\"']{{4,}}+(?=[\"'])",
        rf"({_ASSIGNED})(?=[a-z]*[A-Z0-9!@#$%^&*_+-])[^\s\"'<>,;()]{{4,}}+",
    ],
    "name": [
        rf"(?=\p{{Lu}}){_EDGE}(?!{_LEAD})(?:(?:{TITLES})\.?\x20\p{{Lu}}\p{{Ll}}++|(?!(?:{TITLES})\b)\p{{Lu}}\p{{Ll}}++(?=\x20(?:(?:{PARTICLES})\x20){{0,2}}(?!(?:{TITLES})\b)\p{{Lu}}))(?:(?:\x20(?:{PARTICLES})){{0,2}}\x20(?!(?:{TITLES})\b)\p{{Lu}}(?:\p{{Ll}}++|\.)){{0,3}}(?!\p{{L}})"
    ],
    "address": [
        rf"(?=[0-9\p{{Lu}}rcapvb]){_EDGE}(?:[0-9]{{1,5}}[a-zA-Z]?,?\x20(?:[\p{{Lu}}0-9][\p{{L}}.'-]{{0,19}}\x20){{1,3}}(?:{STREETS})|(?:{STREETS_FIRST})\x20(?:[\p{{L}}.'-]{{1,20}}[\x20,]{{1,2}}){{1,4}}[0-9]{{1,5}}|\p{{Lu}}\p{{Ll}}{{1,20}}(?:{STREETS_JOINED})\x20[0-9]{{1,4}}[a-z]?){_END}"
    ],
    "account": [rf"(?=[A-Z0-9]){_EDGE}(?:[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}|[A-Z]{{1,2}}[0-9]{{6,9}}[A-Z]?|[0-9]{{8}}-?[A-Z]){_END}"],
    "birth_date": [
        rf"(?=[0-9JFMASOND])(?<![0-9./-])(?:[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-](?:19|20)[0-9]{{2}}|(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}(?:\.|st|nd|rd|th)?\x20(?:de\x20)?(?:{MONTHS})\x20(?:de\x20)?(?:19|20)[0-9]{{2}}|(?:{MONTHS})\x20[0-9]{{1,2}}(?:st|nd|rd|th)?,?\x20(?:19|20)[0-9]{{2}})(?![0-9])"
    ],
}
#: What a text must have for any pattern of a kind to match: texts without it are not searched.
NEEDS = {
    "email": lambda t: t.contains("@"), "phone": lambda t: t.contains("+"), "ip": lambda t: t.rlike("[0-9]"), "card": lambda t: t.rlike("[0-9]"),
    "address": lambda t: t.rlike("[0-9]"), "account": lambda t: t.rlike("[0-9]"), "birth_date": lambda t: t.rlike("[0-9]"),
}
#: kind -> name -> SQL condition on a candidate: m (its characters), before and after (what stands around it). Labelers
#: of AGAINST vote that it is none, those of FOR that it is one: by pattern, by a list of words, or by context.
AGAINST = {
    "secret": {
        "digits_only": "m rlike '^[0-9_+/-]+$'",
        "word_with_number": "m rlike '^[A-Za-z]+[_/+]?[0-9]{0,4}$' AND NOT m rlike '^[A-Z0-9]{16,}$'",
        "other_word_before": f"lower(before) rlike '{_TAIL(OTHER_WORDS)}'",
        "path_or_address": "(m rlike '/' AND m rlike '[a-z]{3,}') OR before rlike '[@/.]$' OR after rlike '^@'",
    },
    "name": {
        "no_name": f"m rlike '(?:^| )(?:{NOT_NAMES})(?: |$)'",
        "sentence_start": f"before rlike '(?:^|[.!?:]\\\\s*|\\\\n)$' AND NOT m rlike '(?:^| )(?:{GIVEN_NAMES}|{TITLES})(?: |[.])'",
        "no_sign": f"NOT (m rlike '^(?:{TITLES})[. ]' OR m rlike '(?:^| )(?:{GIVEN_NAMES})(?: |$)' OR lower(before) rlike '(?<!\\\\p{{L}})(?:{NAME_CUES})[^\\\\p{{L}}]*$')",
        "repeats": "m rlike '(?:^| )(\\\\p{L}+) \\\\1(?: |$)'",
        "longer_run": "after rlike '^[ ,]{1,2}\\\\p{Lu}' AND before rlike '\\\\p{Lu}\\\\p{Ll}*[ ,]{1,2}$'",
    },
    "address": {
        "a_year": "m rlike '(?:^|[ ,])(?:19|20)[0-9]{2}(?:[ ,]|$)'",
        "lower_case": f"NOT m rlike '[ ,]\\\\p{{Lu}}' AND NOT m rlike '^\\\\p{{Lu}}'",
        "other_word_before": f"lower(before) rlike '{_TAIL(OTHER_WORDS)}'",
    },
    "account": {
        "other_word_before": f"lower(before) rlike '{_TAIL(OTHER_WORDS + '|no|nr|flight|room|type|code')}'",
        "in_an_address": "before rlike '[/@#=._-]$' OR after rlike '^[/@=._-]'",
        "fails_check": "m rlike '^[A-Z]{2}[0-9]{2}[ A-Z0-9]{8,}$' AND NOT checks",
        "no_context": f"NOT lower(before) rlike '(?:{ACCOUNT_WORDS})' AND NOT checks",
    },
    "birth_date": {
        "other_date": "lower(before) rlike '(?:published|posted|updated|accessed|retrieved|copyright|since|until|dated|due|expires|version|release[ds]?)[^\\\\p{L}]*$'",
        "recent": "CAST(regexp_extract(m, '((?:19|20)[0-9]{2})', 1) AS INT) > 2015",
        "no_birth_word": f"NOT lower(before) rlike '(?<![\\\\p{{L}}])(?:{BIRTH_WORDS.replace(chr(92), chr(92) * 2)})(?![\\\\p{{L}}])'",
    },
}
FOR = {
    "secret": {
        "access_key": "m rlike '^(?:AKIA|ASIA|AGPA|AROA)[0-9A-Z]{16}$'",
        "known_prefix": "m rlike '^(?:sk|pk|rk|ghp|gho|ghs|xox[abp]|glpat)[_-][A-Za-z0-9_-]{10,}$'",
        "capital_code": "m rlike '^[A-Z0-9]{16,}$' AND m rlike '[A-Z]'",
        "hexadecimal": "m rlike '^[0-9a-f]{16,}$' AND m rlike '[a-f]' AND m rlike '[0-9]'",
        "mixed": "regexp_count(m, '[A-Za-z][0-9]|[0-9][A-Za-z]') >= 4",
        "secret_word_before": f"lower(before) rlike '{_TAIL(SECRET_WORDS)}'",
        "assigned": "before rlike '[=:]\\\\s*[\"\\']?$'",
    },
    "name": {
        "title": f"m rlike '^(?:{TITLES})[. ]' OR before rlike '(?:{TITLES})[.]? $'",
        "given_name": f"m rlike '(?:^| )(?:{GIVEN_NAMES})(?: |$)'",
        "cue": f"lower(before) rlike '(?<!\\\\p{{L}})(?:{NAME_CUES})[^\\\\p{{L}}]*$'",
        "initial": "m rlike ' \\\\p{Lu}[.] '",
    },
    "address": {
        "capital_street": "m rlike '[ ,]\\\\p{Lu}' OR m rlike '^\\\\p{Lu}'",
        "cue": f"lower(before) rlike '(?<!\\\\p{{L}})(?:{ADDRESS_CUES})[^\\\\p{{L}}]*$'",
        "place_after": "after rlike '^[., ]{1,3}(?:[0-9]{4,5}|\\\\p{Lu}\\\\p{Ll})'",
    },
    "account": {
        "word_before": f"lower(before) rlike '(?:{ACCOUNT_WORDS})'",
        "checks": "checks",
        "word_close": f"lower(before) rlike '(?:{ACCOUNT_WORDS})(?: number| no| nr| code)?[^\\\\p{{L}}\\\\p{{N}}]*$'",
    },
    "birth_date": {
        "birth_word": f"lower(before) rlike '(?<![\\\\p{{L}}])(?:{BIRTH_WORDS.replace(chr(92), chr(92) * 2)})(?![\\\\p{{L}}])'",
        "birth_word_close": f"lower(before) rlike '(?<![\\\\p{{L}}])(?:{BIRTH_WORDS.replace(chr(92), chr(92) * 2)})(?: on| date| am| le| el)?[^\\\\p{{L}}\\\\p{{N}}]*$'",
        "sign_before": "before rlike '[*:]\\\\s*$'",
    },
}
LEARNED = list(CANDIDATES)
MOST_LABELERS = max(len(AGAINST[k]) + len(FOR[k]) for k in LEARNED)
#: group -> SQL array of a candidate's values in it; the classifier takes the mean
#: evidence of each group, as values of one group tell much the same; of the labelers' votes, a group too, it takes the sum.
FEATURES = {
    "length": "array(least(floor(length(m) / 4), 16))",
    "shape": "array(concat(floor(8 * length(regexp_replace(m, '[^0-9]', '')) / length(m)), ' ', floor(4 * length(regexp_replace(m, '[^\\\\p{Lu}]', '')) / length(m)), ' ', least(regexp_count(m, '[A-Za-z][0-9]|[0-9][A-Za-z]'), 8)))",
    "grams": f"array_distinct(transform(regexp_extract_all(concat('^', lower(regexp_replace(m, '[0-9]', '0')), '$'), '(?s)(?=(...))', 1), g -> pmod(crc32(encode(g, 'UTF-8')), {BUCKETS})))",
    "sign": "array(regexp_extract(before, '([^\\\\p{L}\\\\p{N}]{0,2})$', 1))",
    "word": f"array(pmod(crc32(encode(lower(regexp_extract(before, '(\\\\p{{L}}*)[^\\\\p{{L}}]*$', 1)), 'UTF-8')), {BUCKETS}))",
    "words": f"array_distinct(transform(regexp_extract_all(lower(before), '\\\\p{{L}}+', 0), g -> pmod(crc32(encode(g, 'UTF-8')), {BUCKETS})))",
    "after": "array(substr(after, 1, 1))",
}
_SPAN = "array<struct<n:int,at:int,i:int,gap:int,skip:int,size:int,m:string,before:string,after:string>>"


def _matches(text: Column, needs: Column, n: int, at: int, pattern: str, learned: bool) -> Column:
    """Matches in turn, with the code points between each and the one before it."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lead = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if "(" in pattern and pattern.startswith("([:=]") else None
    none = F.lit(None).cast("string")

    def span(x: Column, i: Column) -> Column:
        gap, m = x["g"], x["m"]
        skip = F.length(x["p"]) if lead is not None else F.lit(0)
        own = F.substr(m, skip + 1, F.length(m)) if lead is not None else m
        before = F.right(F.concat(F.right(gap, F.lit(CONTEXT)), x["p"]) if lead is not None else gap, F.lit(CONTEXT)) if learned else none
        after = F.left(x["a"], F.lit(CONTEXT)) if learned else none
        fields = {"n": F.lit(n), "at": F.lit(at), "i": i, "gap": F.length(gap), "skip": skip, "size": F.length(own), "m": own, "before": before, "after": after}
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    parts = [gaps.alias("g"), found.alias("m"), F.slice(gaps, 2, F.size(gaps)).alias("a"), *([lead.alias("p")] if lead is not None else [])]
    zipped = F.filter(F.arrays_zip(*parts), lambda x: x["m"].isNotNull())
    return F.when(needs & text.rlike(pattern), F.transform(zipped, span)).otherwise(F.array()).cast(_SPAN)


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = digit * 2
        return F.when(i % 2 == 0, digit).otherwise(doubled - F.when(doubled > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _checks(m: Column) -> Column:
    """Check digits of an IBAN, or a social security number's shape."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.left(bare, F.lit(4))), "")
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + digit(c)) % 97)
    iban = m.rlike("^[A-Z]{2}[0-9]{2}[ A-Z0-9]{8,}$") & (rest == 1)
    return F.when(m.rlike("^[A-Z]{2}[0-9]{2}[ A-Z0-9]{8,}$"), iban).otherwise(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"))


def _passes(n: Column, m: Column) -> Column:
    """Whether what the pattern of the n-th base kind matched counts."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    many = F.length(digits)
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    ip = F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substr(part(p), F.lit(1), F.lit(3)).cast("int") <= 255))
    card = F.when(many.between(12, 19), _luhn(digits)).otherwise(False)
    return F.when(n == 0, True).when(n == 1, ip).when(n == 2, card).otherwise(many.between(9, 15))


def classify(candidates: DataFrame) -> DataFrame:
    """`candidates` (kind, m, before, after and any other columns; cheap to read again) with `chance` of being of that kind.

    For each kind labelers vote or abstain; expectation-maximisation over the patterns of votes gives their
    reliabilities and each candidate's posterior. With these as soft labels a naive Bayes classifier over FEATURES is
    counted, n-grams of the span and words before it among them, and it decides. No candidates: no rows.
    """
    order = {k: [(c, -1) for c in AGAINST[k].values()] + [(c, 1) for c in FOR[k].values()] for k in LEARNED}
    vote = lambda k, j: f"CASE WHEN {order[k][j][0]} THEN {order[k][j][1]} ELSE 0 END" if j < len(order[k]) else "0"
    arms = " ".join(f"WHEN '{k}' THEN array({', '.join(vote(k, j) for j in range(MOST_LABELERS))})" for k in LEARNED)
    row, votes, features, checks, odds = free(candidates.columns, "row", "votes", "features", "checks", "odds")
    checked = candidates.withColumn("checks", F.when(F.col("kind") == "account", _checks(F.col("m"))).otherwise(False))
    checked = checked.withColumn(votes, F.expr(f"CASE kind {arms} END"))
    cast = f"filter(transform({votes}, (v, j) -> IF(v = 0, NULL, j)), v -> v IS NOT NULL)"
    values = F.array(*(F.expr(f"named_struct('g', '{g}', 'v', transform({x}, v -> CAST(v AS STRING)))") for g, x in (FEATURES | {"votes": cast}).items()))
    voted = cut(checked.select(*candidates.columns, votes, values.alias(features), F.monotonically_increasing_id().alias(row)))
    soft = accuracies(voted.withColumnRenamed(votes, "votes"), MOST_LABELERS, "kind").select("kind", F.explode("patterns").alias("x")).select("kind", F.col("x.votes").alias(votes), F.col("x.q").alias("q"))
    labelled = voted.select("kind", votes, features).join(F.broadcast(soft), ["kind", votes])  # at most 2 ** MOST_LABELERS rows a kind
    each = labelled.select("kind", "q", F.explode(features).alias("f")).select("kind", "q", "f.g", F.explode("f.v").alias("v"))
    counted = each.groupBy("kind", "g", "v").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no"))
    group = Window.partitionBy("kind", "g")  # as many rows as values, BUCKETS or a few dozen
    rate = lambda c: F.ln((F.col(c) + 0.5) / (F.sum(c).over(group) + 0.5 * F.count(F.lit(1)).over(group)))
    weights = counted.select("kind", "g", "v", (rate("yes") - rate("no")).alias("w"))
    prior = labelled.groupBy("kind").agg(F.ln((F.sum("q") + 1) / (F.sum(1 - F.col("q")) + 1)).alias("prior"))
    own = voted.select(row, "kind", F.explode(features).alias("f")).select(row, "kind", "f.g", F.explode("f.v").alias("v"))
    means = own.join(F.broadcast(weights), ["kind", "g", "v"]).groupBy(row, "kind", "g").agg(F.when(F.col("g") == "votes", F.sum("w")).otherwise(F.avg("w")).alias("w")).groupBy(row, "kind").agg(F.sum("w").alias("w"))
    scored = means.join(F.broadcast(prior), "kind").select(row, (F.col("w") + F.col("prior")).alias(odds))
    return voted.join(scored, row).select(*candidates.columns, (1 / (1 + F.exp(-F.col(odds)))).alias("chance"))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(_row, _id, _hash, spans) for each row of `docs`: spans is an array of structs (s, n, k, e), begin and end in code
    points, in the order of begin, then of kinds (KINDS, then LEARNED); learned ones have chance `least` or more.

    A candidate that lies in a base span is none. Null and empty texts: no spans. Texts may have any number of matches:
    each is a row of its own until positions are summed up. Repeated rows, repeated or null ids: a row each. No rows: no
    rows. Extra columns are not read.
    """
    text = F.col("_text")
    kinds = [*KINDS, *LEARNED]
    patterns = [(n, p) for n, p in enumerate(KINDS.values())] + [(len(KINDS) + n, p) for n, k in enumerate(LEARNED) for p in CANDIDATES[k]]
    needs = lambda n: NEEDS[kinds[n]](text) if kinds[n] in NEEDS else F.lit(True)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    # Each pattern's matches, and the gaps between them, are counted from the text's begin on their own: `at` tells them apart.
    found = [_matches(text, needs(n), n, at, p, n >= len(KINDS)) for at, (n, p) in enumerate(patterns)]
    found = cut(rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_hash", F.concat(*found).alias("_found")))
    each = found.select("_row", F.explode("_found").alias("x")).select("_row", "x.*")
    upto = Window.partitionBy("_row", "at").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("skip") + F.col("size")).over(upto).cast("int")
    placed = cut(each.select("_row", "n", "m", "before", "after", (end - F.col("size")).alias("s"), end.alias("e")))
    base = placed.where(F.col("n") < len(KINDS)).where(_passes(F.col("n"), F.col("m"))).select("_row", "n", "s", "e")

    several = placed.where(F.col("n") >= len(KINDS)).groupBy("_row", "n", "s", "e").agg(F.min("m").alias("m"), F.max_by("before", F.length("before")).alias("before"), F.max("after").alias("after"))
    # Base spans and candidates in the order of their begin: a candidate lies in a base span if one that began before or
    # with it ends with or after it.
    both = several.unionByName(base, allowMissingColumns=True)
    earlier = Window.partitionBy("_row").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    covered = F.max(F.when(F.col("n") < len(KINDS), F.col("e"))).over(earlier)
    open_ = both.withColumn("covered", covered).where((F.col("n") >= len(KINDS)) & (F.col("covered").isNull() | (F.col("covered") < F.col("e"))))
    named = open_.select("_row", "n", "s", "e", "m", "before", "after", F.element_at(F.array(*map(F.lit, kinds)), F.col("n") + 1).alias("kind"))
    learned = classify(named).where(F.col("chance") >= least).select("_row", "n", "s", "e")
    one = F.struct("s", "n", F.element_at(F.array(*map(F.lit, kinds)), F.col("n") + 1).alias("k"), "e")
    spans = base.unionByName(learned).groupBy("_row").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    joined = found.select("_row", "_id", "_hash").join(spans, "_row", "left")
    return joined.select("_row", "_id", "_hash", F.coalesce("spans", F.array().cast("array<struct<s:int,n:int,k:string,e:int>>")).alias("spans"))


def mask(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """`docs` with the spans of personal_data() replaced by their kind in brackets; spans that overlap are replaced as one,
    by the kind of the first.

    Null texts stay null; rows without spans stay as they are, and so do all other columns, whatever their names. Rows
    that repeat an id and its text are masked alike. No rows: no rows. The text is cut into blocks, so that a span is cut
    out of its block and not by counting from the text's begin.
    """
    key, ours, theirs, spans = free(docs.columns, "hash", "found_id", "found_hash", "spans")
    some = found.where(F.size("spans") > 0).dropDuplicates(["_id", "_hash"]).select("_row", "_id", "_hash", F.posexplode("spans").alias("i", "x")).select("_row", "_id", "_hash", "i", "x.s", "x.k", "x.e")
    before = Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = some.withColumn("opens", (F.col("s") >= F.coalesce(F.max("e").over(before), F.lit(0))).cast("int")).withColumn("run", F.sum("opens").over(upto))
    merged = opens.groupBy("_row", "_id", "_hash", "run").agg(F.min("s").alias("s"), F.min_by("k", "i").alias("k"), F.max("e").alias("e"))
    masks = merged.groupBy("_row", "_id", "_hash").agg(F.sort_array(F.collect_list(F.struct("s", "e", "k"))).alias(spans)).select(F.col("_id").alias(ours), F.col("_hash").alias(theirs), spans)

    text = F.col(text_col)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}+"), F.lit(0))

    def piece(b: Column, low: Column, high: Column) -> Column:
        first, last = F.floor(low / block).cast("int"), F.floor(high / block).cast("int")
        head, tail = F.coalesce(F.get(b, first), F.lit("")), F.coalesce(F.get(b, last), F.lit(""))
        inner = F.array_join(F.slice(b, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        apart = F.concat(F.substr(head, low % block + 1, F.lit(block)), inner, F.substr(tail, F.lit(1), high % block))
        return F.when(first == last, F.substr(head, low % block + 1, high - low)).otherwise(apart)

    def masked(b: Column) -> Column:
        at = lambda i: F.when(i == 0, 0).otherwise(F.get(F.col(spans), i - 1)["e"])
        pieces = F.transform(F.col(spans), lambda x, i: F.concat(piece(b, at(i), x["s"]), F.lit("["), x["k"], F.lit("]")))
        rest = piece(b, F.element_at(F.col(spans), -1)["e"], F.length(text))
        return F.array_join(F.concat(pieces, F.array(rest)), "")

    joined = docs.withColumn(key, F.xxhash64(text_col)).join(masks, F.col(id_col).eqNullSafe(F.col(ours)) & (F.col(key) == F.col(theirs)), "left")
    new = F.when(F.col(spans).isNull() | text.isNull(), text).otherwise(F.transform(F.array(blocks), masked).getItem(0))
    return joined.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def personal_data_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned) for each row of `docs`.

    Null and empty texts: no spans. Whole texts of any length count. Repeated rows and repeated or null ids: a row
    each. No rows, or no candidate in any: nothing to learn and no learned spans. Spans of different kinds may overlap.
    Extra columns are not read.
    """
    found = personal_data(docs, id_col=id_col, text_col=text_col)
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    number = lambda n: F.size(F.filter("spans", lambda x: x["n"] == n)).cast("long")
    base = F.filter("spans", lambda x: x["n"] < len(KINDS))
    counts = [number(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return found.select(F.col("_id").alias(id_col), *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_learned"))
