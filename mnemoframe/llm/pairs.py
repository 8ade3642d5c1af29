"""Broken pairs of prompt and response, with the kind of their defect.

A suffix automaton of the prompt measures how much of the response is copied; alternations of refusal phrases (compiled
to automata by the regex engine), a stack of open delimiters, and votes of language-typical words and of scripts find the
rest. Where a response without an end mark may break off within a word, the word pairs of all prompts and golds tell.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions.text import plain_text

# Words for nothing.
NOTHING = ["", "null", "none", "nan", "n a", "na", "nil", "void", "undefined", "empty", "missing", "unknown", "tbd", "blank", "no answer", "no response", "not applicable", "nothing", "nichts", "leer", "keine", "keine angabe", "nada", "ninguno", "ninguna", "sin respuesta", "vacío"]

# Phrases that decline or say that nothing is known; each starts at the start of a word.
REFUSALS = [
    r"i(?:'m| am)? (?:really |very |so |afraid |sorry,? )*(?:but )?(?:i )?(?:(?:do not|don't|did not|didn't) (?:know|have|recall|remember|feel comfortable|find|see)|can ?not|can't|could not|couldn't|won't|will not|would not|wouldn't|am unable|am not able|'m unable|'m not able|unable|not able|not sure|not allowed|not permitted|must decline|decline|have to (?:pass|decline)|would rather not|would prefer not|prefer not)\b",
    r"i'd (?:rather|prefer) not\b", r"sorry\b.{0,40}\b(?:can't|cannot|unable|not|no)\b", r"must decline\b",
    r"as an? (?:ai|assistant|language model|chatbot)\b", r"against my (?:guidelines|policy|policies|rules|instructions|programming)\b",
    r"my (?:instructions|guidelines|rules|policies) (?:do not|don't|forbid|prohibit|prevent)\b", r"not (?:be )?appropriate for me\b", r"can(?:no|')t be (?:answered|disclosed|shared)\b",
    r"no (?:stored |saved |such |relevant |matching )?(?:record|records|entry|entries|information|memory|memories|mention|data|note|notes|trace|details)\b",
    r"nothing (?:in|about|on|is|was|that)\b.{0,40}\b(?:memory|record|stored|known|recorded|session|sessions|question|this|that|answers)\b",
    r"(?:is|are|was|were) (?:not|never) (?:available|known|recorded|mentioned|stored|specified|stated|said)(?=\s*(?:$|[.,;!]|(?:in|anywhere|to me|here|yet|by (?:the|my|any))\b))", r"(?:never|does not|doesn't|do not|don't) (?:says?|mentions?|states?|tells?)\b",
    r"(?:kann|darf|will|möchte|werde|weiß|konnte) ich\b.{0,40}\b(?:nicht|nichts|keine|keinen)\b", r"ich (?:kann|darf|will|möchte|werde|weiß|konnte|habe|finde)\b.{0,50}\b(?:nicht|nichts|keine|keinen)\b",
    r"keine? (?:auskunft|information|informationen|angaben|antwort|eintrag|einträge|aufzeichnung|aufzeichnungen|daten|hinweis)\b", r"(?:nicht bekannt|nichts bekannt|nicht verfügbar|nichts gespeichert|nicht gespeichert)\b", r"muss ich (?:leider )?(?:ablehnen|passen)\b",
    r"(?:tut mir leid|bedaure)\b",
    r"no (?:puedo|tengo|sé|me es posible|dispongo|encuentro|encontré|recuerdo|consta|figura|aparece|se menciona|estoy autorizad[oa]|debo|quiero|podría)\b", r"lo siento\b", r"no hay (?:ningún|ninguna|nada|información|registro|datos|constancia)\b", r"ningún (?:registro|dato)\b",
    r"me temo que no\b", r"prefiero no\b", r"la memoria no\b",
]

# Frequent words that tell a language from the others.
VOTERS = {
    "en": "the of and to was were is are be been this that these with from for by at on it he she they his her their had has have did not you i as or if when which who what where why how would should could will can my your an because since until about into over under next there then than after before while said also only",
    "de": "der die das den dem des ein eine einen einem einer eines und oder ist war waren sind wird wurde hat hatte haben nicht mit von zu zum zur im am auf für bei nach vor aus als wie wenn weil dass es er sie ich wir ihr sich auch noch nur schon aber kein keine keinen hinter unter neben über dort hier seit wegen beide",
    "es": "el los las del al un una unos unas y es fue era eran está están son se su sus por para con sin sobre porque que qué cómo cuándo dónde pero más muy lo le les como también ya había hay ha han este esta eso esa ese desde entre después antes debajo detrás junto estaba cuando todos de la en",
    "fr": "le les des du au aux une et est était étaient sont il elle ils elles on nous vous ce cette ces pas ne plus pour avec sans sur sous dans chez par que qui quand où pourquoi comment mais ou donc car très tout tous après avant pendant depuis se son sa ses leur c n qu d l s j parce de la",
    "it": "il lo gli della dello dei degli delle nel nella e è era erano sono non con per su tra fra che chi come quando dove perché ma anche più molto suo sua loro questo questa dopo prima stato stata di una la",
    "nl": "het een niet zijn wordt werd naar ook maar voor deze bij uit hij zij waar wanneer omdat",
    "sv": "och att inte är på för från också efter blev hade eller mycket",
    "pl": "jest nie się że był była dla przez jak ale oraz gdzie kiedy ponieważ",
    "tr": "bir ve bu için ile değil çok olarak daha gibi sonra çünkü",
    "pt": "o os as do da dos das no na nos nas um uma e é era foi são não com para por sobre que quem como quando onde porquê porque mas também mais muito seu sua este esta depois antes ele ela eles de em",
}
# Scripts that stand for a language or a few; Japanese mixes the last two with the first.
SCRIPTS = {"han": "㐀-䶿一-鿿", "kana": "぀-ヿ", "hangul": "가-힯", "cyrillic": "Ѐ-ӿ", "arabic": "؀-ۿ", "hebrew": "֐-׿", "greek": "Ͱ-Ͽ", "devanagari": "ऀ-ॿ", "thai": "฀-๿"}
MONTHS = {
    "en": "january february march may june july october december monday tuesday wednesday thursday friday saturday sunday times weeks months years",
    "de": "januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag mal wochen monate jahre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miércoles jueves viernes sábado domingo veces semanas meses años",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre lundi mardi mercredi jeudi vendredi samedi dimanche fois semaines mois ans",
}
ASKING = ["who", "whose", "whom", "what", "which", "when", "where", "why", "how", "wer", "wessen", "wem", "wen", "was", "welche", "welcher", "welches", "wann", "wo", "warum", "wieso", "wie", "quién", "qué", "cuál", "cuándo", "dónde", "cómo", "cuánto", "cuántas"]
#: Words after which a text can't end.
OPEN_ENDS = "the a an and or but of to in on at by for from with into than that which who whose because since as if is was were had has his her their its der die das den dem des ein eine und oder aber von zu mit weil dass als el la los las un una y o pero de del que por porque con en se le les et ou du des une dans qui"
COPIED, NEW_WORDS = 0.5, 1
#: Words of an item of a list that is no sentence, uses of a word that make it established, and of a pair of words in golds.
ITEM_WORDS, ESTABLISHED, REPEATED = 3, 5, 3
#: Equal answers to a question are judged once for each range of so many bits of answer ids, which bounds their keys in a row.
KEY_BITS = 16


def _automaton(words: list[str]) -> tuple[list[dict[str, int]], list[int], list[int]]:
    """Suffix automaton over words: transitions, suffix links and longest lengths of its states."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for w in words:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt, link, length


@lru_cache(maxsize=4096)
def _prompt(words: tuple[str, ...]):
    return _automaton(list(words))


def _copied(prompt: tuple[str, ...], words: list[str], run: int = 3) -> float:
    """Share of the words that lie in a stretch of run or more words copied from the prompt."""
    nxt, link, length = _prompt(prompt)
    covered, state, n, upto = 0, 0, 0, 0
    for i, w in enumerate(words):
        while state and w not in nxt[state]:
            state = link[state]
            n = length[state]
        if w in nxt[state]:
            state, n = nxt[state][w], n + 1
        if n >= run:
            covered += i + 1 - max(upto, i + 1 - n)
            upto = i + 1
    return covered / len(words)


def _open_delimiters(text: str) -> bool:
    """Whether a bracket or a quotation is still open at the end of the text."""
    pairs, stack = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}, []
    for ch in text:
        if ch in "([{“«":
            stack.append(ch)
        elif ch == '"':
            stack.pop() if stack and stack[-1] == '"' else stack.append('"')
        elif ch in pairs and stack and stack[-1] == pairs[ch]:
            stack.pop()
    return bool(stack)


_VOTES = {w: [lang for lang in VOTERS if w in (VOTERS[lang] + " " + MONTHS.get(lang, "")).split()] for w in " ".join([*VOTERS.values(), *MONTHS.values()]).split()}
_COMMON = {w for lang in ("en", "de", "es") for w in VOTERS[lang].split()}
_LABELS = {"q", "question", "frage", "pregunta"}


_SCRIPT = re.compile("|".join(f"(?P<{k}>[{v}])" for k, v in SCRIPTS.items()))


def _script(word: str) -> str | None:
    seen = {m.lastgroup for m in _SCRIPT.finditer(word)}
    return "kana" if "kana" in seen else next(iter(seen), None)


def _votes(cased: list[str]) -> dict[str, int]:
    """Votes of the words for languages; runs of capitalised words are names and don't vote."""
    out: dict[str, int] = {}
    for i, w in enumerate(cased):
        if w[0].isupper() and (i and cased[i - 1][0].isupper() or i + 1 < len(cased) and cased[i + 1][0].isupper()) and not w.isupper():
            continue
        for lang in _VOTES.get(w.lower(), ()):
            out[lang] = out.get(lang, 0) + 1
        if not w.isascii() and (script := _script(w)):
            out[script] = out.get(script, 0) + 1
    if "kana" in out:
        out["kana"] += out.pop("han", 0)
    return out


_BETWEEN = re.compile(r",\s*(?:(?:and|or|und|oder|y|o)\s+)?|\s+(?:and|or|und|oder|y|o)\s+")
_ITEM = re.compile(r"\s*(?:\d+[.)]|[-*•])\s+")


def _shape(text: str) -> tuple[bool, bool]:
    """(listing, unfinished) of the last line and the items before it: short parts and no sentence; a last part that is
    shorter than all before, which are alike in length and first word."""
    lines = [x for x in text.rstrip().split("\n") if x.strip()]
    if not lines:
        return False, False
    item = _ITEM.match(lines[-1])
    parts = [x[m.end() :] for x in lines if (m := _ITEM.match(x))] if item else _BETWEEN.split(lines[-1])
    parts = [x.lower().split() for x in parts if x.strip()]
    if not parts:
        return False, False
    listing = not item and all(len(x) <= ITEM_WORDS for x in parts)
    heads = {x[0] for x in parts[:-1]}
    alike = len(heads) == 1 and len({len(x) for x in parts[:-1]}) == 1 and len(parts[-1]) < len(parts[0])
    return listing, alike and (parts[-1][0] in heads or len(parts[-1]) == 1 and next(iter(heads)).startswith(parts[-1][0]))


def _within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


@lru_cache(maxsize=4096)
def _asked(prompt: str) -> tuple[tuple[str, ...], set[str], str | None, list[str]]:
    """(lower words, the same as a set, the asking word, languages of most votes) of a prompt, for all responses to it."""
    q = prompt.split()
    ql, mine = tuple(w.lower() for w in q), _votes(q)
    best = max(mine.values(), default=0)
    return ql, set(ql), next((w for w in ql if w in ASKING), None), [lang for lang, n in mine.items() if n == best]


def _pair(prompt: str, r: list[str], text: str) -> tuple[bool, bool, int, bool, bool, bool]:
    """(echo, other language, words of content shared with the prompt, a delimiter open, listing, unfinished) of one pair."""
    ql, asked, asks, top = _asked(prompt)
    rl = [w.lower() for w in r]
    echo = False
    if len(rl) >= 5 and len(rl) * 2 >= len(ql) and ("?" in text or asks in rl) and _copied(ql, rl) >= COPIED:
        new = {w for w in rl if w not in asked and w not in _LABELS}
        echo = len(new) <= 8 and sum(not any(_within(w, x, 2 if len(w) >= 5 else 1) for x in asked) for w in new) <= NEW_WORDS
    theirs = _votes(r) if len(top) == 1 else {}
    other = len(top) == 1 and max((n for lang, n in theirs.items() if lang != top[0]), default=0) > theirs.get(top[0], 0)
    # What ends with a mark isn't cut off: the rest is asked for other texts only.
    if text.rstrip()[-1:] in set(".!?。！？…"):
        return echo, other, 0, False, False, False
    shared = len({w for w in rl if len(w) > 3 and w in asked and w not in _COMMON})
    return echo, other, shared, _open_delimiters(text), *_shape(text)


def _measure(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for qs, rs, texts in batches:
        yield pd.DataFrame([_pair(q, r.split(), t) for q, r, t in zip(qs, rs, texts)], columns=["echo", "other", "shared", "open", "listing", "unfinished"])


def _words(plain: Column) -> Column:
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{M}\p{N}]+(?:'(?=\p{L})\p{L}+)?"), F.lit(0))


def with_prompt(df: DataFrame) -> DataFrame:
    """df (question, ...) with qs, the words of the plain question in their case with spaces between, as words hold none."""
    return df.withColumn("qs", F.array_join(_words(F.regexp_replace(plain_text(F.coalesce("question", F.lit(""))), "’", "'")), " "))


def defects(pairs: DataFrame) -> DataFrame:
    """pairs (pair_kind, pair_key, question, response) with defect, only defective ones, once each.

    An array pair_keys in the place of pair_key has the keys of all pairs that are equal otherwise, which are judged once.

    Kinds are tried in the order empty, refusal, echo, other_language, truncated. A NULL or blank question leaves only
    the kinds that don't look at it. Responses are judged as a whole, at any length.
    """
    d = pairs if "qs" in pairs.columns else with_prompt(pairs)
    if "pair_keys" not in d.columns:
        d = d.withColumn("pair_keys", F.array("pair_key"))
    d = d.select("pair_kind", "pair_keys", "qs", F.regexp_replace(plain_text(F.coalesce("response", F.lit(""))), "’", "'").alias("r"))
    # A label before the copied prompt is no content of its own.
    d = d.withColumn("rw", _words(F.regexp_replace("r", r"^\s*\p{L}[\p{L} ]{0,20}:\s", "")))
    # Words hold no spaces: one string travels faster than an array of them.
    d = d.withColumn("rs", F.array_join("rw", " ")).withColumn("n", F.size("rw")).drop("rw")
    d = d.withColumn("m", F.pandas_udf(_measure, "echo boolean, other boolean, shared int, open boolean, listing boolean, unfinished boolean")("qs", "rs", "r"))
    unquoted = F.regexp_replace(F.lower("r"), "\"[^\"]*\"|“[^”]*”|«[^»]*»", " ")
    # Only the last line counts for the end of the text.
    line = F.substring_index(F.regexp_replace("r", r"[\s\p{Z}]+$", ""), "\n", -1)
    d = d.withColumn("line", line).withColumn("stops", F.col("line").rlike(r"[.!?。！？…][\"'”’)\]»]*$"))
    line = F.col("line")
    item = line.rlike(r"^\s*(?:\d+[.)]|[-*•])\s")
    # Matches start at the start of a word only, or long words would be tried from each of their letters.
    last = F.lower(F.regexp_extract(line, r"(?<![\p{L}\p{M}\p{N}])([\p{L}\p{M}\p{N}]++)$", 1))
    in_sentence = ~item & (F.col("n") >= 4) & (F.col("m.shared") >= 2) & ~F.col("m.listing")
    cut = (F.col("n") > 0) & ~F.col("stops") & (in_sentence | F.col("m.open") | last.isin(OPEN_ENDS.split()) | line.rlike(r"[,;:(\-–]$") | F.col("m.unfinished"))
    kind = (
        F.when(F.lower("rs").isin(NOTHING), "empty")
        .when(unquoted.rlike(r"\b(?:" + "|".join(REFUSALS) + ")"), "refusal")
        .when(F.col("m.echo"), "echo")
        .when(F.col("m.other"), "other_language")
        .when(cut, "truncated")
    )
    # The last two words of what may break off within a word; other rows get a key of their own, which meets nothing.
    two = r"(?<![\p{L}\p{M}\p{N}])([\p{L}\p{M}\p{N}]++) ([\p{L}\p{M}]++)$"
    ends = lambda k: F.when(k.isNull() & ~F.col("stops"), F.regexp_extract(line, two, 0))
    one = F.transform(F.array(kind), lambda k: F.struct(k.alias("kind"), F.split(ends(k), " ").alias("end")))
    # An exploded array instead of a filter, which the optimizer would compute a second time.
    d = d.select("pair_kind", "pair_keys", F.inline(F.filter(one, lambda o: o["kind"].isNotNull() | (F.size(o["end"]) == 2))))
    d = d.select("pair_kind", "pair_keys", "kind", F.coalesce(_keyed(F.get("end", F.lit(0))), F.concat(F.lit("\u0001"), F.get("pair_keys", F.lit(0)))).alias("p"), F.coalesce(F.lower(F.get("end", F.lit(1))), F.lit("")).alias("x"))
    j = d.join(_beginnings(pairs).withColumn("broken", F.lit("truncated")), ["p", "x"], "left")
    found = j.select("pair_kind", "pair_keys", F.coalesce("kind", "broken").alias("defect")).where("defect IS NOT NULL")
    return found.select("pair_kind", F.explode("pair_keys").alias("pair_key"), "defect").distinct()


def _keyed(word: Column) -> Column:
    """A word as the first of a pair: lower case, all numbers alike."""
    return F.when(word.rlike(r"^\p{N}+$"), "#").otherwise(F.lower(word))


def _beginnings(pairs: DataFrame) -> DataFrame:
    """(p, x): x begins an established word that follows p in prompts or, time and again, in golds, and never follows p itself."""
    pair_of = lambda c: F.regexp_extract_all(F.lower(plain_text(c)), F.lit(r"(?<![\p{L}\p{M}\p{N}])(?=([\p{L}\p{M}\p{N}]++ [\p{L}\p{M}]++)(?!\p{N}))"), F.lit(1))
    samples = pairs.where("pair_kind = 'sample'")
    text = samples.select(F.explode(F.array(F.struct(F.lit(True).alias("asked"), F.col("question").alias("t")), F.struct(F.lit(False).alias("asked"), F.col("response").alias("t")))).alias("s"))
    two = text.select("s.asked", F.explode(pair_of(F.col("s.t"))).alias("w")).select("asked", F.split("w", " ").alias("w")).select("asked", _keyed(F.col("w")[0]).alias("p"), F.col("w")[1].alias("x"))
    seen = two.groupBy("p", "x").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).where((F.col("asked") > 0) | (F.col("n") >= REPEATED))
    seen = seen.withColumn("known", F.sum("n").over(Window.partitionBy("x")) >= ESTABLISHED)
    upto = F.sequence(F.when(F.col("known"), F.lit(1)).otherwise(F.length("x")), F.length("x"))
    parts = seen.select("p", "x", F.explode(upto).alias("i")).select("p", F.substring("x", F.lit(1), F.col("i")).alias("x"), (F.col("i") == F.length("x")).cast("int").alias("whole"))
    return parts.groupBy("p", "x").agg(F.max("whole").alias("whole")).where("whole = 0").select("p", "x")


def benchmark_pairs(samples: DataFrame, answers: DataFrame) -> DataFrame:
    """Question and gold of each sample, and question and answer of each answer without error that is no abstention.

    With pair_keys; equal answers to a sample are one row for each range of KEY_BITS bits of their ids.
    """
    s = with_prompt(samples.select("sample_id", "question", "gold").where("sample_id IS NOT NULL").distinct())
    a = answers.where("error IS NULL AND NOT coalesce(abstained, false) AND answer_id IS NOT NULL AND sample_id IS NOT NULL")
    a = a.groupBy("sample_id", "answer", F.shiftright("answer_id", KEY_BITS).alias("range")).agg(F.collect_set("answer_id").cast("array<string>").alias("pair_keys"))
    of_samples = s.select(F.lit("sample").alias("pair_kind"), F.array("sample_id").alias("pair_keys"), "question", "qs", F.col("gold").alias("response"))
    of_answers = a.join(s, "sample_id").select(F.lit("answer").alias("pair_kind"), "pair_keys", "question", "qs", F.col("answer").alias("response"))
    return of_samples.unionByName(of_answers)
