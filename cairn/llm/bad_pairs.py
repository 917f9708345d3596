"""Broken prompt and response pairs, each with its one defect.

'empty' needs the answer alone.  'echo' traverses a suffix automaton of the question's words and measures what
part of the answer is copied; nothing but words of asking may be left.  'refusal' runs an
automaton over the words of each sentence that accepts a denial near a word of knowing, finding or saying, whatever the
wording.  'truncated' keeps a stack of
delimiters, and where the answer merely lacks its final mark, a second detector, statistics of all texts,
tells whether its last words ever end a sentence.  'other_language' takes a vote of stop words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.stopwords import SCRIPTS, STOPWORDS
from cairn.session import checkpointed

STAMP = re.compile(r"\s*\(~\s[^()]*\(\w{2,4}\.?\)\s\d{1,2}:\d\d\)\s*$|\s*\(~\s[^()]*\)\s*$")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Times that a long ending must occur to be judged by itself.
FEW = 3
ENDS = ".!?…。！？؟।"
CLOSERS = "\"'”’»)]}*`"
PAIRS = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
# An answer of these words alone is filler.
FILLER = {"null", "none", "nil", "nan", "na", "n/a", "empty", "undefined", "void", "tbd", "todo", "blank", "boş", "vacío", "leer", "vide", "vuoto"}
# Words of asking, with which an echo is framed.
ASKING = set(
    """you asked ask asking question questions good great nice interesting query your prompt the is was
    sordun soru sorun sorunuz sordunuz güzel iyi şu şunu bu
    preguntado preguntaste pregunta preguntas buena has la es tu su gran
    gefragt frage fragst lautet gute du hast die ist deine ihre
    demandé question bonne vous avez est la votre chiesto domanda buona hai è perguntou pergunta boa
    q a user assistant""".split()
)
# Beginnings of words that deny, and of words of knowing, finding, saying and helping, by language.  A sentence with
# one of either within NEAR words of each other declines; '=' stands before whole words.
DENYING = {
    "en": "=not =no =never =none =nothing =nobody =neither =without =cannot =don't =doesn't =didn't =can't =couldn't =won't =wouldn't =isn't =aren't =wasn't =weren't =haven't =hasn't =ain't unable impossible refus declin lack",
    "tr": "=yok =değil =hiç =hiçbir =yoktur",
    "es": "=no =nunca =ni =sin =ningún =ninguna =ninguno =nada =nadie =tampoco =jamás imposible carezco",
    "de": "=nicht =nichts =nie =niemals =niemand =ohne kein unmöglich",
    "fr": "=ne =pas =jamais =aucun =aucune =rien =sans =impossible",
    "it": "=non =mai =nessun =nessuna =niente =nulla =senza impossibile",
    "pt": "=não =nunca =nenhum =nenhuma =nada =sem impossível",
}
KNOWING = {
    "en": "know knew tell told say =said =state =states =stated answer help assist find found recall remember recollect inform record mention idea clue =sure =certain determin confirm verif locat trace evidence data detail access aware familiar cover document specif list line note =able =about",
    "tr": "bilgi kayıt kaydı satır fikr fikir emin iz veri not şey yanıt cevap ipucu söz bahis",
    "es": "=sé sab pued podr poder encontr encuentr consta mencion inform dato record recuerd dic =dijo dicho respond contest respuesta idea segur registr aparec figur ayud hay tengo dispon =contar contad =contó posible",
    "de": "weiß wiss wusst sag gesagt find gefunden beantwort antwort helf helfen erwähn eintrag angabe information ahnung bekannt sicher erinner steht hinweis auskunft notiz daten hervor ersichtlich quelle zeile lässt kann könn",
    "fr": "sais savoir peux pouv trouv trace information mention répon réponse idée =sûr dit",
    "it": "so sapere posso potere trovat trovo traccia informazion menzion rispond risposta idea sicur detto noto",
    "pt": "sei saber posso poder encontr registro informa mencion respond resposta ideia certeza disse",
}
NEAR = 4
# Turkish denies within the verb: roots of knowing, finding and saying, and the endings of denial behind them.
TURKISH = r"(?:bil|bul|bulun|hatırla|anımsa|söyle|söylen|yanıtla|yanıtlan|cevapla|cevaplan|ulaş|rastla|geç|görün|anlat|anlatıl|belirt|belirtil|bahsed|bahsedil|edil|veril|yer al|ver|ol)(?:y?[ae])?m[aeıiuü]\w*"
# What says that a question stays without answer and denies nothing.
OPEN = "stay open|stays open|remain open|remains open|leave open|leave it open|leave that open|left open|unknown|unanswerable|açık kal|belirsiz|bilinmez|abiert|desconoc|ignoro|offen|unbekannt|sans réponse|inconnu|sconosciut|ignoro|desconhec"
# Beginnings of what may stand beside a refusal and still answers nothing: regret, requests, advice.
ASIDES = """sorry|afraid|unfortunately|regret|apolog|to be honest|please|could you|can you|would you|tell me|ask|try|add|rather not|guess|let me know|hm
    |üzgün|maalesef|ne yazık|açıkçası|lütfen|misin|mısın|tahmin|sor|ekle|özür
    |lo siento|perdon|disculp|por desgracia|lament|la verdad|puedes|podrías|prefiero|pregunt|añad|agreg|adivin
    |leider|leid|entschuldig|ehrlich|kannst du|könntest du|lieber nicht|bitte|frag|füg|rate"""


def fold(text: str) -> str:
    """One case for a text: letters whose case is not one to one fall together."""
    return unicodedata.normalize("NFKC", text).upper().casefold().replace("̇", "")


_fold_word = lru_cache(1 << 16)(fold)
_FILLER = frozenset(map(fold, FILLER))
_ASKING = frozenset(map(fold, ASKING))
_VERB = re.compile(fold(TURKISH).replace("\\W", "\\w"))


@cache
def _automaton(text: str):
    """Aho-Corasick automaton of phrases; a space bounds a phrase's first word."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in filter(None, (fold(p.strip()) for p in text.replace("\n", " ").split("|"))):
        found.add_word(f" {w}", w)
    found.make_automaton()
    return found


@cache
def _classes() -> list[tuple[frozenset, tuple, frozenset, tuple]]:
    """(whole words, beginnings) of denial and of knowing, for each language."""
    split = lambda text: (frozenset(fold(w[1:]) for w in text.split() if w[0] == "="), tuple(fold(w) for w in text.split() if w[0] != "="))
    return [(*split(DENYING[x]), *split(KNOWING[x])) for x in DENYING]


@lru_cache(1 << 16)
def _roles(word: str) -> tuple[int, int, bool]:
    """Bits of the languages in which a word denies, and in which it is one of knowing; and whether it denies by itself."""
    deny = know = 0
    for i, (whole, begins, known, starts) in enumerate(_classes()):
        deny |= (word in whole or bool(begins) and word.startswith(begins)) << i
        know |= (word in known or word.startswith(starts)) << i
    return deny, know, _VERB.fullmatch(word) is not None


def _plain(sentence: str) -> str:
    return " " + re.sub(r"\s+", " ", re.sub(r"[^\w\s'/]", " ", fold(sentence).replace("’", "'")))


def _denies(text: str) -> bool:
    """A denial within ``NEAR`` words of a word of knowing, in one language; or a verb that denies; or a question left open."""
    last: list[tuple[int, int, int]] = []
    for at, word in enumerate(text.split()):
        deny, know, itself = _roles(word)
        if itself:
            return True
        if deny or know:
            for i, d, k in reversed(last):
                if at - i > NEAR:
                    break
                if deny & k or know & d:
                    return True
            last.append((at, deny, know))
    return next(_automaton(OPEN).iter(text), None) is not None


def _says(kind: str, sentence: str) -> bool:
    text = _plain(sentence)
    return _denies(text) if kind == "refusal" else next(_automaton(ASIDES).iter(text), None) is not None


class SuffixAutomaton:
    """All runs of words of a question, in a number of states linear in its words."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            new = self._state({}, self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][w]
                if self.length[q] == self.length[p] + 1:
                    self.link[new] = q
                else:
                    twin = self._state(dict(self.next[q]), self.length[p] + 1)
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[new] = twin
            last = new

    def _state(self, out: dict[str, int], length: int) -> int:
        self.next.append(out)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def copied(self, words: list[str]) -> tuple[list[bool], int]:
        """(whether each word lies in a copied run of at least two, the longest run)."""
        hit, opens, state, run, longest = [False] * len(words), [0] * (len(words) + 1), 0, 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state, run = self.next[state][w], run + 1
            longest = max(longest, run)
            if run >= 2:  # a difference array: copied runs open and close
                opens[i - run + 1] += 1
                opens[i + 1] -= 1
        depth = 0
        for i in range(len(words)):
            depth += opens[i]
            hit[i] = depth > 0
        return hit, longest


@lru_cache(1024)
def _suffixes(words: tuple[str, ...]) -> SuffixAutomaton:
    return SuffixAutomaton(words)


def words_of(text: str) -> list[str]:
    return _short_words(text) if len(text) < 500 else WORD.findall(fold(text))


@lru_cache(1 << 14)
def _short_words(text: str) -> list[str]:
    return WORD.findall(fold(text))


@cache
def _votes() -> dict[str, dict[str, float]]:
    table: dict[str, set[str]] = {}
    for language, words in STOPWORDS.items():
        for w in words.split():
            table.setdefault(fold(w), set()).add(language)
    return {w: {x: 1 / len(langs) for x in langs} for w, langs in table.items()}


# Signs that of the languages known here one alone writes (a name's do not count), and languages that lose a tie.
SIGNS = {"ı": "tr", "ğ": "tr", "ş": "tr", "ß": "de", "¿": "es", "¡": "es", "ñ": "es"}
SELDOM = ("nl", "sv", "pl", "id", "pt", "it")
_SCRIPT = {name: re.compile(f"[{span}]") for name, span in SCRIPTS.items()}
_FAR = re.compile(f"[{''.join(SCRIPTS.values())}]")


def votes(text: str) -> Counter:
    """Votes for each language; half or more letters of another script outvote all words."""
    out: Counter = Counter()
    if not text.isascii():
        if _FAR.search(text):
            letters = sum(map(str.isalpha, text))
            for name, pattern in _SCRIPT.items():
                if letters and 2 * len(pattern.findall(text)) >= letters:
                    return Counter({name: 100.0})
        for sign, language in SIGNS.items():
            if sign in text:
                out[language] += sum(sign in w for w in text.split() if not w[:1].isupper())
    known = _votes()
    for w in words_of(text):
        for x in {w, *w.split("'")} if "'" in w else (w,):
            if x in known:
                for language, part in known[x].items():
                    out[language] += part
    return Counter({x: n * (0.9 if x in SELDOM else 1.0) for x, n in out.items()})


_QUOTE = re.compile("[\"“”„«»‘’`]")


def without_quotes(text: str) -> str:
    return re.sub(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|‘[^’]*’|`[^`]*`", " ", text)


@lru_cache(4096)
def _asked(question: str) -> tuple[Counter, str | None]:
    counted = votes(question)
    return counted, _leading(counted)


def language(question: str) -> str | None:
    """The language with most votes, where it leads."""
    return _asked(question)[1]


def _leading(counted: Counter) -> str | None:
    top = counted.most_common(2)
    if not top or len(top) > 1 and top[0][1] == top[1][1]:
        return None
    return top[0][0]


def in_other_language(question: str, body: str) -> bool:
    """Another language than the question's clearly leads outside quotations and copied words."""
    asked, own = _asked(question)
    if own is None:
        return False
    said = votes(without_quotes(body) if _QUOTE.search(body) else body)
    if not said:
        return False
    best, most = said.most_common(1)[0]
    return best != own and asked[best] < asked[own] and most >= 0.5 and most > 2 * said[own]


def unclosed(text: str) -> bool:
    """A delimiter that the text opens is left open (a stack of them; stray closers are passed over)."""
    stack: list[str] = []
    for c in text:
        if c in "([{«“":
            stack.append(c)
        elif c in PAIRS and stack and stack[-1] == PAIRS[c]:
            stack.pop()
        elif c == "„":
            stack.append("“")
        elif c == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            else:
                stack.append('"')
    return bool(stack)


@cache
def _unseen() -> re.Pattern:
    """Format and control characters."""
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, (*range(0x20000), *range(0xE0000, 0xE0200))) if unicodedata.category(c) in ("Cf", "Cc")) + "]")


def is_empty(body: str) -> bool:
    """Nothing to read: no letter or digit, or filler words alone."""
    if body.isascii():
        shown = re.sub(r"[\x00-\x1f\x7f]", "", body)
    else:
        shown = _unseen().sub("", unicodedata.normalize("NFKC", body))
    # the first word that is no filler ends the search
    return all(fold(m[0]) in _FILLER for m in re.finditer(r"[^\W_]+(?:/[^\W_]+)*", shown))


def is_echo(question: str, body: str, gold: str | None) -> bool:
    asked, said = words_of(question), words_of(body)
    if not asked or not said:
        return False
    hit, longest = _suffixes(tuple(asked)).copied(said)
    if len(asked) == 1:
        hit, longest = [w == asked[0] for w in said], int(asked[0] in said)
    rest = [w for w, h in zip(said, hit) if not h]
    if longest < 0.8 * len(asked) or any(w not in _ASKING for w in rest):
        return False
    wanted = words_of(gold or "")
    return not (wanted and set(wanted) <= set(rest))


def sentences(body: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?…])\s+|\n+", body) if WORD.search(s)]


_COLON = re.compile(r"(?<=\w):\s+")


def declines(text: str) -> bool:
    """All sentences decline, apologise or ask back, and at least one declines; a colon ends a sentence too."""
    declined = False
    for sentence in sentences(text):
        for part in _COLON.split(sentence):
            if not WORD.search(part):
                continue
            if _says("refusal", part):
                declined = True
            elif not (_says("aside", part) or part.rstrip().endswith("?")):
                return False  # something is said
    return declined


def is_refusal(question: str, body: str, gold: str | None) -> bool:
    if gold is None or not gold.strip() or not declines(body) or _says("refusal", gold):
        return False
    wanted, said = words_of(gold), words_of(body)
    if wanted and " ".join(wanted) in " ".join(said):
        return False
    asked = set(words_of(question))
    return not any(any(c.isdigit() for c in w) and w not in asked for w in said)


def shape(token: str) -> str:
    """A word as the statistics see it: digits are alike, and so are capitalised words."""
    if token[:1].isdigit():
        return re.sub(r"\d", "0", token)
    return "Xx" if token[:1].isupper() else _fold_word(token)


def grams(sentence: str) -> list[tuple[str, str, str, str]]:
    """Keys of the endings at each word of a sentence, the longest first; a bracketed part is one word.

    '4:' has three words as they stand before the last shape; '3:', '2:' and '1:' are shapes.
    """
    words = WORD.findall(re.sub(r"\([^()]*\)", " parenthesis ", sentence))
    # a name of several words is one word
    words = [w for w, after in zip(words, [*words[1:], ""]) if not (w[:1].isupper() and after[:1].isupper())]
    shapes = ["<s>", "<s>", "<s>", *(shape(w) for w in words)]
    plain = ["<s>", "<s>", "<s>", *map(_fold_word, words)]
    return [
        (
            f"4:{' '.join(plain[i - 3 : i])} {shapes[i]}", f"3:{' '.join(shapes[i - 2 : i + 1])}",
            f"2:{' '.join(shapes[i - 1 : i + 1])}", f"1:{shapes[i]}",
        )
        for i in range(3, len(shapes))
    ]


def finished(body: str) -> bool:
    """The text ends with a sentence's mark, closing delimiters aside."""
    return body.rstrip().rstrip(CLOSERS).rstrip()[-1:] in tuple(ENDS)


def body_of(said: str) -> str:
    return STAMP.sub("", said)


def judged(question: str | None, gold: str | None, said: str | None) -> tuple[str | None, str | None]:
    """(defect, ending): the defect that the pair alone shows, and the unfinished ending that statistics must judge."""
    body = body_of(said or "")
    question = question or ""
    if is_empty(body):
        return "empty", None
    text = body.rstrip()
    if is_echo(question, text, gold):
        return "echo", None
    if unclosed(text) or re.search(r"(?:…|\.\.\.)[\"'”»]?$|[^\W_][-‐–]$|[,;:]$", text):
        return "truncated", None
    ending = None
    if not finished(text) and masked(text) != masked(gold or ""):
        ending = text
    if is_refusal(question, body, gold):
        return "refusal", ending
    if in_other_language(question, body):
        return "other_language", ending
    return None, ending


def masked(text: str) -> str:
    return re.sub(r"\d", "0", " ".join(words_of(text)))


def endings(pairs: DataFrame) -> DataFrame:
    """(gram, n, final): how often the last words of any length occur in all texts, and how often they end a sentence.

    Keys are those of ``grams``, 'w:' for words as they stand and 'g:' for whole golds with digits alike.
    The unfinished last sentence of a text says nothing about endings and is left out.
    Each different question, gold and said text counts once, whatever rows, batches and files hold it; counted within
    each batch first, then combined before and after one shuffle.
    """
    kinds = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("text")) for c in ("question", "gold", "said")))).alias("t")
    texts = pairs.select(kinds).select("t.kind", "t.text").filter("text is not null").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter = Counter()
            final: Counter = Counter()
            for kind, text in batch.itertuples(index=False):
                if kind != "said":
                    n.update(f"w:{w}" for w in words_of(text))
                    if kind == "gold":
                        n[f"g:{masked(text)}"] += 1
                    continue
                for part in sentences(body_of(text)):
                    if not finished(part):
                        part = part[: m.start()] if (m := re.search(r"\S+\s*$", part)) else ""
                        n.update(f"w:{w}" for w in words_of(part))
                        for keys in grams(part):
                            n.update(keys)
                        continue
                    n.update(f"w:{w}" for w in words_of(part))
                    listed = grams(part)
                    for keys in listed:
                        n.update(keys)
                    final.update(listed[-1] if listed else ())
            yield pd.DataFrame({"gram": list(n), "n": list(n.values()), "final": [final[k] for k in n]})

    return texts.mapInPandas(count, "gram string, n long, final long").groupBy("gram").agg(
        F.sum("n").alias("n"), F.sum("final").alias("final")
    )


PAIR = "pair_id long, defect string, four string, three string, two string, one string, word string, whole string"


def defects(pairs: DataFrame, share: float = 0.5) -> DataFrame:
    """(pair_id, defect) of each defective pair; whole pairs have no row, and no pair has two.  See ``detected``."""
    return detected(pairs, share).select("pair_id", "defect").distinct()


def detected(pairs: DataFrame, share: float = 0.5) -> DataFrame:
    """(pair_id, defect, detector): 'pair' where the pair alone shows the defect, 'endings' where the statistics of all texts do.

    Null answers are 'empty', null questions and golds are treated as missing.  Rows repeated exactly
    count once; a null pair_id is kept as null.  ``share`` is the part of an ending's occurrences
    that must end a sentence for an answer without a final mark to be whole.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in PAIR.split(", ")]
        for batch in batches:
            rows = []
            for pair, question, gold, said in batch.itertuples(index=False):
                defect, ending = judged(question, gold, said)
                if defect is None and ending is None:
                    continue
                last: tuple = (None, None, None, None)
                word = whole = None
                if ending is not None:
                    parts = sentences(ending)
                    listed = grams(parts[-1]) if parts else []
                    last = listed[-1] if listed else last
                    said_words = words_of(ending)
                    word = f"w:{said_words[-1]}" if said_words else None
                    whole = f"g:{masked(ending)}"
                rows.append((pair, defect, *last, word, whole))
            yield pd.DataFrame(rows, columns=names).astype({"pair_id": "Int64"})

    source = pairs.select(F.col("pair_id").cast("long").alias("pair_id"), "question", "gold", "said")
    seen = checkpointed(source.mapInPandas(judge, PAIR))  # defective and open pairs only; read twice below
    sure = seen.filter("whole is null").select("pair_id", "defect")
    open_ = seen.filter("whole is not null")
    counts = endings(pairs)
    # every unfinished row asks for six keys: one long join, then back to a row a pair
    asked = open_.select(
        "pair_id", "defect",
        F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("gram")) for k in ("four", "three", "two", "one", "word", "whole")))).alias("a"),
    ).select("pair_id", "defect", "a.kind", "a.gram")
    known = asked.join(counts, "gram", "left").groupBy("pair_id", "defect").agg(
        *(F.max(F.when(F.col("kind") == k, F.coalesce("n", F.lit(0)))).alias(k) for k in ("four", "three", "two", "one", "word", "whole")),
        *(F.max(F.when(F.col("kind") == k, F.col("final") / F.col("n"))).alias(f"{k}_end") for k in ("four", "three", "two", "one")),
    )
    ends = F.coalesce(
        F.when(F.col("four") >= FEW, F.col("four_end")), F.when(F.col("three") > 0, F.col("three_end")), F.when(F.col("two") > 0, F.col("two_end")),
        F.when(F.col("one") > 0, F.col("one_end")), F.lit(0.0),
    )
    cut = (F.col("whole") == 0) & ((F.coalesce("word", F.lit(0)) == 0) | (ends < share))
    settled = known.select("pair_id", F.when(cut, "truncated").otherwise(F.col("defect")).alias("defect"), F.when(cut, "endings").otherwise("pair").alias("detector"))
    return sure.withColumn("detector", F.lit("pair")).unionByName(settled).filter("defect is not null").distinct()
