"""Tokens, tags, chunks and verb groups of English text, as pure functions over one text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

PUNCT = set(".,!?'`\";:][(){}<>")
ENDERS = set(".?!")
ABBREVIATIONS = {x + "." for x in "Mr Mrs Ms Dr Prof Rev Gen Sen Rep Gov Lt Col Sgt Capt St Jr Sr Inc Corp Co Ltd Bros Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Wed Thu Fri Sat Sun No vs etc e.g i.e a.m p.m approx dept est".split()}
CLOSING_ABBREVIATIONS = {"Inc.", "Corp.", "Co.", "Ltd.", "Jr.", "Sr.", "etc.", "a.m.", "p.m.", "Bros."}
STARTERS = set("The A An He She It They We I You This That These Those But And In On At When If For As His Her Their Its Mr. Mrs. Ms. Dr.".split())
_WORD = re.compile(r"\S+")
_NOT = re.compile(r"^(\w+)(n't)$", re.I)
_TAIL = re.compile(r"^(\w+)('(?:t|d|s|m|re|ll|ve|s))$", re.I)


@dataclass(slots=True)
class Token:
    begin: int
    end: int
    text: str
    sentence: int = 0
    pos: str = ""
    lemma: str = ""
    chunk: int = -1


def scan(text: str) -> list[tuple[int, int]]:
    """Maximal runs without white space."""
    return [m.span() for m in re.finditer(r"\S+", text)]


def peel(word: str) -> tuple[str, str, str]:
    """(opening signs, core, closing signs); a word of signs alone is all opening."""
    a, b = 0, len(word)
    while a < b and word[a] in PUNCT:
        a += 1
    while b > a and word[b - 1] in PUNCT:
        b -= 1
    core, close = word[a:b], word[b:]
    if core and close[:1] == "." and (core + "." in ABBREVIATIONS or re.fullmatch(r"([A-Z]\.)*[A-Z]", core)):
        core, close = core + ".", close[1:]
    return word[:a], core, close


def contraction(core: str) -> list[str]:
    """Two parts of a contracted word, or the word."""
    m = _NOT.match(core) or _TAIL.match(core)
    return list(m.groups()) if m else [core]


def _split(word: str) -> tuple[tuple[str, ...], bool, bool, str]:
    """A word's tokens in order, whether its signs end a sentence, whether it is an abbreviation that may, and its opening signs with its core."""
    opening, core, close = peel(word)
    parts = (*opening, *(contraction(core) if core else ()), *close)
    return parts, not ENDERS.isdisjoint(close), not close and core in CLOSING_ABBREVIATIONS, opening + core


_split_short = lru_cache(1 << 16)(_split)


def tokenize(text: str) -> list[Token]:
    """Tokens with offsets and sentence numbers (from 0)."""
    out, number, maybe = [], 0, False
    for m in _WORD.finditer(text):
        word = m[0]
        parts, ends, short, shown = _split_short(word) if len(word) < 32 else _split(word)
        if maybe and shown in STARTERS:
            number += 1
        at = m.start()
        for part in parts:
            e = at + len(part)
            out.append(Token(at, e, part, number))
            at = e
        maybe = short and not ends
        if ends:
            number += 1
    return out


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines, without white space at their ends."""
    out, at = [], 0
    for m in [*re.finditer(r"\s*\n\s*?\n\s*", text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            out.append((at + lead, at + len(part.rstrip())))
        at = m.end() if m else end
    return out


# Part-of-speech tagging: closed classes, irregular verbs, endings

_CLOSED = {
    "DT": "the a an this that these those every each another some any no all both",
    "PRP": "i you he she it we they me him us them himself herself itself themselves",
    "PRP$": "my your his its our their her",
    "MD": "will would can could may might must shall should 'll 'd ca wo cannot",
    "IN": "in on at by for of from with about against between into through during before after above below over under since until than like near because while if whether although though as without within toward towards upon across behind beyond per",
    "CC": "and or but nor yet",
    "TO": "to",
    "WDT": "which",
    "WP": "who whom what",
    "WRB": "when where why how",
    "EX": "there",
    "RB": "not n't never also only very too now then today tomorrow yesterday tonight again already still soon just almost often always here so far ago once later earlier even quite",
    "JJ": "old new open green sole good bad last next past other many few several first second third big small long high low great free ready able likely possible happy sad rational crucial ill sick dead alive past most",
    "CD": "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion",
    "VB": "be have do go come make take get see know think say give find tell become leave feel put bring begin keep hold write stand hear let mean set meet run pay sit speak lead read grow lose fall send build understand draw break spend cut rise drive buy wear choose sleep win eat fly sing try stop start continue want need seem help show play move like live believe happen include allow add walk offer remember love consider appear wait serve die expect stay reach kill remain suggest raise pass sell require report decide pull discuss plan refuse decline fail promise order agree propose announce deny claim bark travel visit attack punish place ship deliver",
    "VBZ": "is has does says goes",
    "VBP": "are am 'm 're 've do",
    "VBD": "was were had did said went came made took got saw knew thought gave found told became left felt put brought began kept held wrote stood heard let meant set met ran paid sat spoke led read grew lost fell sent built understood drew broke spent cut rose drove bought wore chose slept won ate flew sang ordered shipped",
    "VBN": "been gone done seen known given taken written spoken grown fallen drawn broken risen driven worn chosen eaten flown sung begun become made built sent",
    "NN": "war peace explosion attack crash meeting election strike trial fire flood earthquake storm death birth accident absence presence man woman door wall year month week day hour minute second morning evening night afternoon spring summer fall autumn winter order sentence document war time home support family fence agreement interview",
}
_CLOSED["VB"] += " maintain provide investigate calculate resume prefer seek acknowledge confirm indicate argue complain reduce increase develop produce create receive obtain acquire achieve defend protect improve establish represent replace recover repay resolve respond reveal search seize settle solve succeed suffer supply survive suspend talk teach tend threaten throw touch train transfer treat urge warn withdraw wonder worry admit accept accuse adopt advise affect afford anticipate apologize appoint approve arise arrive assume attempt avoid become blame borrow capture celebrate collapse combine compete concentrate conclude conduct convince convict deal defeat define demand depend deserve destroy die disappear discover dismiss eliminate emerge encourage enjoy ensure enter escape evacuate examine expand expire explain explode explore face fill finance finish follow forget free gain generate govern handle hang happen harm hire identify imagine impose inform insist invade invest invite involve join justify land launch learn limit link lower manage match merge negotiate notice object obey occupy occur oppose organize owe participate persuade pledge pour predict prepare pretend prohibit prove push realize rebuild recall recognize recommend refer reflect regard regret reject release rely renew repeat restore restrict retain retire return reverse review save select separate share shift shoot sign smoke speed spread steal strengthen stretch struggle submit supervise surrender surround swear tell terminate testify trust undermine undergo unite vote wage welcome yell use".replace(" become", "").replace(" tell", "")
_CLOSED["VBD"] += " sold bought sought fought caught taught hit hurt shot shook swore stole struck sank swam threw tore undertook withdrew froze forgot forgave hid laid lay lent lit quit rang rode shut slid spun stuck swept swung woke wept bit blew bore bent bound bred burst cast clung crept dealt dug fed fled flung forbade ground hung knelt leapt sent shone shrank slept slit sped spilt spat split sprang strove"
_CLOSED["VBN"] += " shaken sworn stolen struck sunk swum thrown torn undertaken withdrawn frozen forgotten forgiven hidden rung ridden woken bitten blown borne forbidden shrunk sprung striven shown proven beaten hit hurt shot sold sought fought caught taught"
_CLOSED["NN"] += " anything everything something nothing thing king ring string wing ceiling spring trade result support referendum accusation outcome block turn drop bid due"
_CLOSED["JJ"] += " willing such more enough lower higher unclear okay equal"
_CLOSED["RB"] += " ever up down out away off forward back together however instead perhaps maybe"
LEXICON: dict[str, str] = {}
for _tag, _words in _CLOSED.items():
    for _w in _words.split():
        LEXICON.setdefault(_w, _tag)
_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_IRREGULAR = {"was": "be", "were": "be", "is": "be", "are": "be", "am": "be", "been": "be", "being": "be", "'m": "be", "'re": "be", "has": "have", "had": "have", "'ve": "have", "having": "have", "did": "do", "does": "do", "done": "do", "said": "say", "went": "go", "gone": "go", "came": "come", "made": "make", "took": "take", "taken": "take", "got": "get", "saw": "see", "seen": "see", "knew": "know", "known": "know", "thought": "think", "gave": "give", "given": "give", "found": "find", "told": "tell", "became": "become", "left": "leave", "felt": "feel", "brought": "bring", "began": "begin", "begun": "begin", "kept": "keep", "held": "hold", "wrote": "write", "written": "write", "stood": "stand", "heard": "hear", "meant": "mean", "met": "meet", "ran": "run", "paid": "pay", "sat": "sit", "spoke": "speak", "spoken": "speak", "led": "lead", "grew": "grow", "grown": "grow", "lost": "lose", "fell": "fall", "fallen": "fall", "sent": "send", "built": "build", "understood": "understand", "drew": "draw", "drawn": "draw", "broke": "break", "broken": "break", "spent": "spend", "rose": "rise", "risen": "rise", "drove": "drive", "driven": "drive", "bought": "buy", "wore": "wear", "worn": "wear", "chose": "choose", "chosen": "choose", "slept": "sleep", "won": "win", "ate": "eat", "eaten": "eat", "flew": "fly", "flown": "fly", "sang": "sing", "sung": "sing"}
_IRREGULAR |= {"sold": "sell", "sought": "seek", "fought": "fight", "caught": "catch", "taught": "teach", "shot": "shoot", "stole": "steal", "stolen": "steal", "struck": "strike", "threw": "throw", "thrown": "throw", "withdrew": "withdraw", "withdrawn": "withdraw", "swore": "swear", "sworn": "swear", "forgot": "forget", "forgotten": "forget", "hid": "hide", "hidden": "hide", "laid": "lay", "lent": "lend", "rode": "ride", "ridden": "ride", "shown": "show", "beaten": "beat", "blew": "blow", "blown": "blow", "dealt": "deal", "fed": "feed", "fled": "flee", "hung": "hang", "swept": "sweep", "woke": "wake", "shook": "shake", "shaken": "shake"}
_VERB_STEMS = set(_CLOSED["VB"].split())
#: Nouns first, but verbs after "to" or a modal.
_NOUN_VERBS = set("attack strike order support fence block turn drop bid trade double like fire trial visit travel place ship name head face fund halt hope report plan offer question request cause guard risk set back center form start stop end hand help lead ring land fight vote test check hold call look talk walk watch work study research sample".split())
#: Linking verbs: what looks like a past form after them is an adjective.
_LINKING = {"become", "remain", "seem", "look", "feel", "stay"}


@lru_cache(1 << 17)
def lemma(word: str, pos: str) -> str:
    w = word.lower()
    if w in _IRREGULAR and pos[:1] in ("V", "M"):
        return _IRREGULAR[w]
    if pos[:2] in ("VB", "NN"):
        for end, back in (("ies", "y"), ("ied", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
            if w.endswith(end) and len(w) > len(end) + 1 and not (end == "s" and w.endswith("ss")) and (end in ("ies", "s", "es", "sses") or pos in ("VBG", "VBD", "VBN")):
                stem = w[: -len(end)] + back
                for guess in (stem, stem + "e", stem[:-1] if len(stem) > 2 and stem[-1:] == stem[-2:-1] else stem):
                    if guess in _VERB_STEMS or guess in _NOUN_VERBS or LEXICON.get(guess) in ("NN", "VB"):
                        return guess
                if end in ("es",) and stem[-1:] not in "sxzh":
                    return stem + "e"
                return stem
    return w


def strip_plural(word: str) -> str:
    """A noun without its plural ending, by endings alone."""
    return word[:-2] if word.endswith("sses") else word[:-1] if word.endswith("s") and not word.endswith("ss") else word


@lru_cache(1 << 17)
def _guess(word: str, first: bool) -> str:
    low = word.lower()
    if word in _MONTHS or word in _DAYS:
        return "NNP"
    if low in LEXICON:
        return LEXICON[low]
    if re.fullmatch(r"[\d,.:/'-]*\d[\d,.:/-]*s?", word):
        return "CD"
    if re.fullmatch(r"\d+(st|nd|rd|th)", low):
        return "JJ"
    if len(word) == 1 and word in PUNCT:
        return "." if word in ENDERS else {",": ",", "'": "''", "`": "``", '"': "''"}.get(word, ":")
    if not first and word[:1].isupper():
        return "NNPS" if low.endswith("s") and not low.endswith("ss") else "NNP"
    if low.endswith("ly"):
        return "RB"
    if low.endswith("ing") and len(low) > 4:
        return "VBG"
    if low.endswith("ed") and len(low) > 3:
        return "JJ" if low.startswith("un") and len(low) > 6 and lemma(low, "VBD") not in _VERB_STEMS else "VBD"
    if re.search(r"(ous|ful|able|ible|ive|al|ic|less|ish|ary)$", low):
        return "JJ"
    if low.endswith("s") and not low.endswith("ss"):
        stem = lemma(low, "VBZ")
        return "VBZ" if stem in _VERB_STEMS else "NNS"
    return "NNP" if word[:1].isupper() and first and len(word) > 3 and not low.endswith("e") else "NN"


def tag(tokens: list[Token]) -> list[Token]:
    """Part of speech and lemma of each token, in place."""
    before: Token | None = None
    for k, t in enumerate(tokens):
        first = before is None or before.sentence != t.sentence
        p = _guess(t.text, first)
        prev = "" if first else before.pos
        word = t.text.lower()
        ahead = tokens[k + 1].text.lower() if k + 1 < len(tokens) and tokens[k + 1].sentence == t.sentence else ""
        if p == "VBD" and prev and before is not None:
            back = [x for x in tokens[max(0, k - 3) : k] if x.sentence == t.sentence and x.pos != "RB"]
            if back and back[-1].lemma in ("be", "have", "get") and back[-1].pos[0] in "VM":
                p = "VBN"
        if p in ("VB", "VBP") and (prev in ("NNS", "PRP", "NNPS", "WP") or (before is not None and before.text.lower() in ("men", "women", "people", "children", "police") and prev)):
            p = "VBP"
        if p == "VB" and prev in ("DT", "PRP$", "JJ", "IN", "CD") and word not in ("be", "have"):
            p = "NN"
        lead = ""  # the tag before, adverbs passed over
        if prev:
            back = next((x for x in reversed(tokens[max(0, k - 3) : k]) if x.sentence == t.sentence and x.pos != "RB"), None)
            lead = back.pos if back is not None else ""
            if p in ("VB", "VBD") and back is not None and back.lemma == "have" and back.pos[0] == "V" and word in ("become", "come", "run", "overcome", "put", "cut", "set", "hit", "read"):
                p = "VBN"
            if p == "VBD" and back is not None and back.lemma in _LINKING and back.pos[0] == "V":
                p = "JJ"
        if p in ("NN", "IN", "JJ", "RB", "VBP") and lead == "MD" and word not in ("not", "n't") and not word.endswith("ly") and LEXICON.get(word) not in ("RB", "IN", "JJ", "CC") or (word == "like" and lead in ("MD", "NNS", "PRP") and (lead == "MD" or ahead == "to")):
            p = "VB"
        if p == "NN" and prev == "PRP" and ahead == "to" and not word.endswith("s"):
            p = "VBP"
        if p == "NN" and lead == "TO" and (word in _VERB_STEMS | _NOUN_VERBS or (ahead and _guess(ahead, False) in ("DT", "PRP$", "PRP", "WP", "WRB", "TO"))):
            p = "VB"
        if p == "VBG" and prev in ("DT", "PRP$", "JJ"):
            p = "NN"
        if p == "VBD" and prev in ("DT", "PRP$") and ahead and _guess(ahead, False)[0] == "N":
            p = "VBN"
        if p == "EX" and ahead not in ("is", "was", "are", "were", "has", "have", "will", "may"):
            p = "RB"
        if word == "her" and not (ahead and _guess(ahead, False)[:2] in ("NN", "JJ", "VB", "CD")):
            p = "PRP"
        if word == "that" and ahead and _guess(ahead, False) in ("PRP", "DT", "PRP$", "NNS", "NNP", "NNPS", "EX") and not (first and _guess(ahead, False) == "NNS"):
            p = "IN"
        if word == "'s":
            p = "POS" if ahead and _guess(ahead, False)[:2] in ("NN", "JJ") and prev[:1] == "N" else "VBZ"
        t.pos, t.lemma = p, "be" if word == "'s" and p == "VBZ" else lemma(t.text, p)
        before = t
    return tokens


def normalize_pos(pos: str) -> str:
    """TreeTagger names as Penn names."""
    if pos[:2] in ("VV", "VH"):
        pos = "VB" + pos[2:]
    return {"SENT": ".", "NP": "NNP", "NPS": "NNPS", "IN/that": "IN", "PP": "PRP", "PP$": "PRP$"}.get(pos, pos)


NOUN = (set("DT PRP$ CD JJ JJR JJS NN NNS NNP NNPS VBG VBN".split()), set("PRP$ EX CD JJ JJR JJS NN NNP NNPS NNS VBG VBN".split()), set("NN NNS NNP NNPS".split()))
VERB = (set("TO MD VB VBD VBG VBN VBP VBZ".split()), set("RB RP VB VBD VBG VBN VBP VBZ".split()), set("VB VBD VBG VBN VBP VBZ".split()))


def chunks(tokens: list[Token], terms: set[tuple[int, int]] = frozenset()) -> list[tuple[str, int, int]]:
    """(ng or vg, first token, end token) of one sentence: the longest that the tag sets allow, noun groups first.

    `terms`: spans of known events; one headed by a noun or a verb is a chunk of its own. The last token
    begins no chunk.
    """
    out, k, n = [], 0, len(tokens)
    while k < n - 1:
        forced = next(((k, j) for j in range(n, k, -1) if (tokens[k].begin, tokens[j - 1].end) in terms and tokens[j - 1].pos[:1] in "NV"), None)
        if forced:
            out.append(("ng" if tokens[forced[1] - 1].pos[0] == "N" else "vg", *forced))
            k = forced[1]
            continue
        found = None
        for name, (initial, inside, final) in (("ng", NOUN), ("vg", VERB)):
            if name == "ng" and tokens[k].pos == "VBG" and tokens[k + 1].pos in ("PRP$", "DT"):
                continue  # a gerund with its object
            if tokens[k].pos in initial:
                j, last = k, k if tokens[k].pos in final else -1
                while j + 1 < n and tokens[j + 1].pos in inside:
                    j += 1
                    last = j if tokens[j].pos in final else last
                if last >= 0:
                    found = (name, k, last + 1)
                    break
        if not found and tokens[k].pos in ("PRP", "PP"):
            found = ("ng", k, k + 1)
        if found:
            out.append(found)
        k = found[2] if found else k + 1
    # V(not be) VBG | N...: the -ing form belongs to the noun group
    for i in range(len(out) - 1):
        (a, s, e), (b, t, f) = out[i], out[i + 1]
        if a == "vg" and b == "ng" and e == t and e - s > 1 and tokens[e - 1].pos == "VBG" and tokens[e - 2].pos[:2] == "VB" and tokens[e - 2].lemma != "be" and tokens[t].pos[0] == "N":
            out[i], out[i + 1] = (a, s, e - 1), (b, e - 1, f)
    return [(n, s + a, s + b) for n, s, e in out for a, b in (sub_groups(tokens[s:e]) if n == "vg" else [(0, e - s)])]


# Verb groups

MODALS = {"will", "would", "can", "could", "may", "might", "must", "shall", "should", "ca", "wo", "'ll", "'d", "ought", "cannot"}
_MODAL_NAME = {"ca": "can", "cannot": "can", "'d": "would", "wo": "will", "'ll": "will"}
_FUTURE = {"will", "'ll", "shall", "wo"}


@dataclass
class Verb:
    tense: str
    aspect: str
    modality: str
    polarity: str
    head: int
    passive: bool = False


def verb_group(tokens: list[Token]) -> Verb | None:
    """Tense, aspect, modality and polarity of a verb group, read off its auxiliaries from left to right."""
    negative = any(t.text.lower() in ("not", "n't", "never", "cannot") for t in tokens)
    only = any(t.text.lower() == "only" for t in tokens)
    core = [(k, t) for k, t in enumerate(tokens) if t.pos[:2] in ("VB", "MD", "TO")]
    verbs = [(k, t) for k, t in core if t.pos[:2] == "VB"]
    if not verbs:
        return None
    head, last = verbs[-1]
    words = [(t.text.lower(), t.lemma, t.pos) for _, t in core]
    modality: list[str] = []
    tense, aspect, passive = "", [], False
    k = 0
    if words[0][2] == "TO":
        tense, k = "INFINITIVE", 1
    while k < len(words):
        w, stem, pos = words[k]
        rest = words[k + 1 :]
        if pos == "MD" or w in MODALS:
            if w in _FUTURE:
                tense = tense or "FUTURE"
            else:
                modality.append(_MODAL_NAME.get(w, w))
                tense = tense or "NONE"
        elif pos == "TO":
            pass
        elif stem == "have" and len(rest) > 1 and rest[0][2] == "TO":  # have to
            modality.append("have to")
            tense = tense or _finite(w, pos)
        elif stem == "be" and len(rest) > 2 and rest[0][0] == "going" and rest[1][2] == "TO":  # be going to
            tense = "FUTURE" if _finite(w, pos) == "PRESENT" and not tense else tense or _finite(w, pos)
            k += 1
        elif w == "used" and len(rest) > 1 and rest[0][2] == "TO":
            tense = "PAST"
        elif stem == "do" and rest:
            tense = tense or _finite(w, pos)
        elif stem == "have" and rest and rest[0][2] in ("VBN", "VBD"):
            tense = tense or _finite(w, pos)
            aspect.append("PERFECTIVE")
        elif stem == "be" and rest and rest[0][2] == "VBG":
            tense = tense or _finite(w, pos)
            aspect.append("PROGRESSIVE")
        elif stem == "be" and rest and rest[0][2] in ("VBN", "VBD"):
            tense = tense or _finite(w, pos)
            passive = True
        else:
            tense = tense or _finite(w, pos)
        k += 1
    return Verb(tense or "NONE", "_".join(dict.fromkeys(aspect)) or "NONE", " ".join(modality) or "NONE", "NEG" if negative and not only else "POS", head, passive)


def _finite(word: str, pos: str) -> str:
    if word in ("was", "were", "had", "did") or pos == "VBD":
        return "PAST"
    return {"VBZ": "PRESENT", "VBP": "PRESENT", "VB": "INFINITIVE", "VBN": "PASTPART", "VBG": "PRESPART"}.get(pos, "NONE")


_CLASSES = (
    ("I_STATE", "believe think want hope expect plan intend wish desire need love hate like fear feel know doubt suspect"),
    ("REPORTING", "say report tell announce state claim add explain declare note describe quote cite warn testify"),
    ("PERCEPTION", "see watch hear view witness notice observe overhear glimpse"),
    ("I_ACTION", "try attempt seek avoid prevent delay order offer promise propose agree decide refuse decline fail ask request persuade allow cause help block deny investigate swear vow"),
    ("ASPECTUAL", "begin start initiate commence stop end halt finish complete continue keep resume restart cease quit"),
    ("STATE", "be remain stay exist live seem appear belong contain own possess lack"),
)
VERB_CLASS = {w: name for name, ws in _CLASSES for w in ws.split()}
STATIVE_ADJECTIVES = set("able afraid anxious eager glad happy likely ready sure unable willing worried".split())
EVENT_NOUNS = set("war attack explosion crash meeting election strike trial fire flood earthquake storm death birth accident negotiation talks battle fight murder arrest visit trip travel game race sale purchase merger takeover agreement announcement collapse bombing invasion killing presence crisis investigation hearing trade result support referendum accusation campaign interview conference embargo vote raid riot protest demonstration deployment withdrawal treaty ceremony wedding funeral rally tour mission operation rescue search evacuation drought famine hurricane accusation promise decision effort deal bid production growth decline increase reduction recession recovery inflation violence terrorism genocide massacre assassination shooting stabbing robbery theft ban boycott blockade invasion occupation siege surrender truce ceasefire summit debate discussion speech announcement launch landing flight voyage journey".split())
#: Nouns that are events where they are definite only.
DEFINITE_NOUNS = {"absence", "arrival", "departure", "return", "failure", "success", "loss", "growth"}
_DEFINITE = {"the", "this", "that", "these", "those"}


def definite(tokens: list[Token], s: int, h: int) -> bool:
    """Whether a noun group that begins at s has a possessive or a definite determiner before its head."""
    return any(t.pos in ("POS", "PRP$") or t.text.lower() in _DEFINITE for t in tokens[s:h])


def is_event_noun(tokens: list[Token], s: int, h: int, nouns: set[str]) -> bool:
    stem = strip_plural(tokens[h].text.lower())
    return definite(tokens, s, h) if stem in DEFINITE_NOUNS else stem in nouns


def sub_groups(tokens: list[Token]) -> list[tuple[int, int]]:
    """A verb group in parts: a main verb ends one where another in -ing follows it."""
    cuts = [k for k in range(1, len(tokens)) if tokens[k].pos == "VBG" and tokens[k - 1].pos[:2] == "VB" and tokens[k - 1].lemma not in ("be", "have")]
    return list(zip([0, *cuts], [*cuts, len(tokens)]))


def events(tokens: list[Token], groups: list[tuple[str, int, int]], nouns: set[str] = EVENT_NOUNS, taken: set[int] = frozenset()) -> list[dict]:
    """Events of one sentence: the head token of each verb group, its adjective or noun complement, and event nouns."""
    out: dict[int, dict] = {}
    in_chunk = {i: g for g in groups for i in range(g[1], g[2])}

    def noun(s: int, e: int, needs: bool = True) -> None:
        h = e - 1
        if tokens[h].pos[:2] == "NN" and is_event_noun(tokens, s, h, nouns) and h not in taken and h not in out:
            out[h] = {"token": h, "class": "OCCURRENCE", "tense": "NONE", "aspect": "NONE", "modality": "NONE", "polarity": "POS", "pos": "NOUN"}

    k = 0
    while k < len(groups):
        name, s, e = groups[k]
        if name == "vg":
            # have to, be going to, used to run over several chunks that touch
            while k + 1 < len(groups) and groups[k + 1][0] == "vg" and groups[k + 1][1] == e and tokens[e].pos == "TO" and (tokens[e - 1].lemma in ("have", "go") or (tokens[e - 1].text.lower() == "used" and tokens[e - 1].pos == "VBD")):
                e = groups[k + 1][2]
                k += 1
            v = verb_group(tokens[s:e])
            if v and s and tokens[s - 1].text.lower() == "never":
                v.polarity = "NEG"
            if v:
                h = s + v.head
                t = tokens[h]
                row = {"token": h, "class": VERB_CLASS.get(t.lemma, "OCCURRENCE"), "tense": v.tense, "aspect": v.aspect, "modality": v.modality, "polarity": v.polarity, "pos": "VERB"}
                nxt = e
                while nxt < len(tokens) and tokens[nxt].pos == "RB":
                    nxt += 1
                group = in_chunk.get(nxt)
                if t.lemma == "be" and not (t.text.lower() == "including" and v.tense == "NONE"):
                    if nxt < len(tokens) and tokens[nxt].pos[:2] == "JJ" and group is None:
                        out[nxt] = row | {"token": nxt, "class": "I_STATE" if tokens[nxt].text.lower() in STATIVE_ADJECTIVES else "STATE", "pos": "ADJECTIVE"}
                    elif group and group[0] == "ng" and is_event_noun(tokens, group[1], group[2] - 1, nouns):
                        out[group[2] - 1] = row | {"token": group[2] - 1, "class": "OCCURRENCE", "pos": "NOUN"}
                elif t.text.lower() != "including" and h not in taken:
                    out[h] = row
                    if t.lemma == "keep" and group and group[0] == "ng":
                        nxt = group[2]
                        group = in_chunk.get(nxt)
                    if t.lemma in ("become", "continue", "keep", "remain") and nxt < len(tokens) and tokens[nxt].pos[:2] == "JJ" and group is None:
                        out[nxt] = row | {"token": nxt, "class": "STATE", "pos": "ADJECTIVE", "tense": "NONE", "aspect": "NONE"}
        else:
            noun(s, e)
        k += 1
    for i, t in enumerate(tokens):
        if i not in in_chunk and t.pos[:2] == "NN":
            noun(i, i + 1)
    return [out[k] for k in sorted(out)]
