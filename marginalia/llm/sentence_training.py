"""A labelled table for sentence boundaries: sentences of common words with known ends, put together at random.

Sentences are made from the public tokenizers' words (``vocabulary``), with what makes boundaries hard among them:
abbreviations, initials, decimals, quotations and brackets with marks of their own, citations, codes, rests without a mark.
"""

from __future__ import annotations

import random

from marginalia.llm.pii_training import Maker, vocabulary

#: Common abbreviations by language, by what stands behind them: a name, a number, any word, or (also) nothing.
NAMED = {
    "en": "Dr. Prof. Mr. Mrs. Ms. St. Gen. Sen. Rep. Gov. Capt. Col. Lt. Sgt. Rev. Hon. Jr. Sr. Mt. Ft. Messrs. Pres. Supt.".split(),
    "de": "Dr. Prof. Hr. Fr. Hrn. St. Dipl.-Ing. Mag. Gebr.".split(),
    "fr": "M. MM. Dr. Pr. Me. St. Ste.".split(),
    "es": "Dr. Dra. Sr. Sra. Srta. D. Dña. Prof. Sto. Sta.".split(),
    "ru": "г. г-н. проф. акад. им. ул. тов. др.".split(),
    "el": "κ. κα. Δρ. καθ. Αγ.".split(),
    "ar": "د. أ. م.".split(),
    "hi": "डॉ. श्री. पं. प्रो.".split(),
}
NUMBERED = {
    "en": "No. no. Fig. Figs. fig. Eq. Eqs. Sect. Sec. Ch. Vol. vol. pp. p. Ref. Refs. Tab. Art. approx. ca. Nr. Jan. Feb. Mar. Apr. Aug. Sept. Oct. Nov. Dec.".split(),
    "de": "Nr. Abb. Tab. Bd. S. Kap. Art. ca. etwa. Abs. Jh.".split(),
    "fr": "fig. p. pp. vol. chap. art. env. n. éd. t.".split(),
    "es": "fig. pág. págs. vol. cap. núm. art. aprox. n.".split(),
    "ru": "рис. стр. табл. гл. т. с. им. ок. п.".split(),
    "el": "σελ. εικ. κεφ. τ. αρ.".split(),
    "ar": "ص. ج.".split(),
    "hi": "पृ. सं.".split(),
}
PLAIN = {
    "en": ["e.g.", "i.e.", "cf.", "vs.", "al.", "viz.", "resp.", "incl.", "ed.", "eds.", "etc.", "U.S.", "U.K.", "a.m.", "p.m.", "Inc.", "Ltd.", "Co.", "Corp.", "Ph.D.", "dept.", "est.", "St.", "Ave."],
    "de": ["z. B.", "d. h.", "u. a.", "o. ä.", "bzw.", "usw.", "vgl.", "sog.", "inkl.", "ggf.", "evtl.", "i. d. R.", "u. U.", "z.B.", "d.h."],
    "fr": ["p. ex.", "c.-à-d.", "cf.", "etc.", "env.", "av.", "apr.", "i.e."],
    "es": ["p. ej.", "etc.", "aprox.", "cf.", "EE. UU.", "a. C.", "Ud.", "Uds."],
    "ru": ["т. е.", "т. д.", "т. п.", "напр.", "см.", "ср.", "т.е.", "и др."],
    "el": ["π.χ.", "δηλ.", "κ.λπ.", "κτλ.", "βλ.", "μ.Χ."],
    "ar": ["إلخ.", "ق.م."],
    "hi": ["उदा.", "ई.पू."],
}
#: Abbreviations that may also be the last word; a capital behind them is then a new sentence.
LAST = {"en": ["etc.", "U.S.", "U.K.", "a.m.", "p.m.", "Inc.", "Ltd.", "Co.", "al."], "de": ["usw.", "u. a."], "fr": ["etc."], "es": ["etc."], "ru": ["и т. д.", "и т. п."], "el": ["κ.λπ.", "κτλ."]}
FINAL = {"zh": "。。。！？…", "ja": "。。。！？", "hi": "।।।!?", "el": "...!;", "ar": "...!؟"}
QUOTES = {"en": ["“”", '""', "‘’", '""'], "de": ["„“", "»«", "„“"], "fr": ["« »", "«»", "“”"], "es": ["«»", "“”", '""'], "ru": ["«»", "„“"], "el": ["«»"], "zh": ["“”", "「」"], "ja": ["「」", "『』"], "ar": ["«»", '""'], "hi": ["“”", '""', "‘’"]}
#: Common first words.
FIRST = {
    "en": "The A An No Not We It This That These Those He She They You I In On At For From With But And Or If When While Because Although However Moreover Each Every Some All Most Her His Their Our There Here Why How What Who e.g. i.e. cf. Mr. Dr.".split(),
    "de": "Der Die Das Ein Eine Kein Wir Es Sie Er In Im Am Nach Für Mit Aber Und Wenn Weil Warum Jede Alle".split(),
    "fr": "Le La Les Un Une Nous Il Elle Ce Cette Dans Pour Avec Mais Et Si Pourquoi Selon Chaque Tous".split(),
    "es": "El La Los Un Una No Nosotros Este Esta En Para Con Pero Y Si Por Según Cada Todos".split(),
    "ru": "В На Не Мы Он Она Это Эти Но И Если Почему Каждый Все По".split(),
    "el": "Η Ο Το Οι Τα Δεν Σε Για Με Αλλά Και Αν Γιατί Κάθε Κατά".split(),
}
#: Final marks of further scripts, on words of their letters.
OTHER = {"።": (0x1208, 0x1240), "፧": (0x1208, 0x1240), "։": (0x0561, 0x0586), "۔": (0x0621, 0x064A), "។": (0x1780, 0x17A2), "။": (0x1000, 0x1020)}
LANGS = ["en"] * 8 + ["de", "de", "fr", "fr", "es", "es", "ru", "el", "zh", "zh", "ja", "ja", "ar", "hi", "th", "th", "other"]
_SPACELESS = ("zh", "ja", "th")


class Writer(Maker):
    def body(self, lang: str, n: int, depth: int = 0) -> list[str]:
        """Pieces of a sentence: words, and now and then what holds marks that end nothing."""
        r, v, out = self.r, self.v[lang], []
        while len(out) < n:
            k = r.random()
            near = r.choice([r.choice(v).capitalize(), self.proper(), str(r.randint(1, 99)), r.choice(v)])
            if lang in _SPACELESS or lang not in NAMED:
                k = 1.0 if k > 0.12 else k / 3
            if k < 0.02:
                out.append(self.filler("c", lang))
            elif k < 0.05:
                out.append(self.filler("n", lang) + ("" if lang in ("zh", "ja") else " " + self.filler("u", lang) if lang != "th" else ""))
            elif k < 0.08:
                out += [r.choice(NAMED[lang]), self.proper() if r.random() < 0.6 else r.choice(v).capitalize()]
            elif k < 0.105:
                out += [r.choice(NUMBERED[lang]), r.choice([str(r.randint(1, 200)), f"{r.randint(1, 9)}.{r.randint(1, 9)}", f"({r.randint(1, 40)})", f"{r.randint(1, 30)}-{r.randint(31, 90)}"])]
            elif k < 0.14:
                out += [r.choice(PLAIN[lang]) + ("," if r.random() < 0.35 else ""), near]
            elif k < 0.155:
                out += [r.choice("ABCDEFGHJKLMNPRST") + "." for _ in range(r.choice([1, 1, 2]))] + [self.proper()]
            elif k < 0.17 and lang in ("de",):
                out += [f"{r.randint(1, 31)}.", r.choice("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())]
            elif k < 0.18:
                out.append(r.choice([f"v{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", f"{r.choice(self.v['en'])}.{r.choice(['csv', 'txt', 'py', 'org', 'com'])}", f"www.{r.choice(self.v['en'])}.net", f"[{r.randint(1, 30)}]", f"[{r.randint(1, 30)}, {r.randint(31, 60)}-{r.randint(61, 70)}]", "..." if r.random() < 0.5 else "…", f"{r.randint(1, 12)}:{r.randint(10, 59)}"]))
            elif k < 0.205 and not depth:
                a, b = r.choice([("(", ")"), ("(", ")"), ("[", "]")])
                inner = " ".join(self.body(lang, r.randint(1, 5), 1))
                out.append(a + inner + r.choice(["", "", ".", "?", "; " + " ".join(self.body(lang, 2, 1)) + "."]) + b)
            else:
                out.append(r.choice(v))
            if not depth and r.random() < 0.02 and lang in QUOTES:
                out.append(self.quoted(lang))
            if r.random() < 0.05 and out and out[-1][-1:].isalnum() and len(out) < n:
                out[-1] += "、" if lang == "ja" else "，" if lang == "zh" else "" if lang == "th" else "،" if lang == "ar" else r.choice(",,,;:") if lang != "el" else ","
        return out

    def quoted(self, lang: str) -> str:
        """A quotation of one or two sentences, whose marks end nothing outside."""
        r = self.r
        q = r.choice(QUOTES[lang])
        a, b = (q[0] + " ", " " + q[-1]) if len(q) == 3 else (q[0], q[-1])
        space = "" if lang in _SPACELESS else " "
        parts = []
        for _ in range(r.choice([1, 1, 2])):
            s = space.join(self.body(lang, r.randint(1, 5), 1))
            parts.append(s[:1].upper() + s[1:] + r.choice(FINAL.get(lang, "..!?")))
        return a + space.join(parts)[: None if r.random() < 0.8 else -1] + b

    def sentence(self, lang: str) -> str:
        r = self.r
        if lang == "other":
            mark = r.choice(list(OTHER))
            return " ".join("".join(chr(r.randint(*OTHER[mark])) for _ in range(r.randint(2, 6))) for _ in range(r.randint(2, 10))) + mark
        space = "" if lang in _SPACELESS else " "
        parts = self.body(lang, r.randint(2, 16))
        k = r.random()
        if lang == "th":
            # Spaces stand at a numeral only.
            s = parts[0] + "".join((f" {r.randint(1, 999)} " if r.random() < 0.07 else "") + p for p in parts[1:])
            return s.strip()
        tail = r.random()
        if tail < 0.12:
            parts.append(self.filler("n", lang) + ("" if lang in ("zh", "ja") else r.choice([" ", " ", "", "\u00a0"]) + self.filler("u", lang) if r.random() < 0.8 else ""))
        elif tail < 0.2 and lang in NUMBERED:
            inner = r.choice([f"{r.choice(NUMBERED[lang])} {r.randint(1, 60)}", f"{r.choice(PLAIN[lang])} {r.choice(NUMBERED[lang])} {r.randint(1, 60)}", " ".join(self.body(lang, 3, 1))])
            parts.append(r.choice(["(" + inner + ")", "(" + inner + ")", f"{r.choice(NUMBERED[lang])} ({r.randint(1, 60)})", f"{r.choice(NUMBERED[lang])} {r.randint(1, 60)}", f"pp. {r.randint(1, 60)}-{r.randint(61, 99)}"]))
        elif tail < 0.26:
            parts.append(self.filler("c", lang))
        elif tail < 0.29 and lang in ("en", "de", "fr", "es"):
            parts.append(self.proper())
        if k < 0.06 and lang in LAST:
            parts.append(r.choice(LAST[lang]))
            s = space.join(parts)
            return s[:1].upper() + s[1:]
        if k < 0.1 and lang in QUOTES:
            parts.insert(0, self.quoted(lang))
        elif k < 0.16 and lang in QUOTES:
            q = self.quoted(lang)
            if r.random() < 0.5 and parts[-1][-1:].isalnum():
                parts[-1] += ":"
            if q[-2:-1] in FINAL.get(lang, ".!?"):
                return self._up(space.join([*parts, q]), lang)
        elif k < 0.2:
            s = self._up(space.join(parts), lang)
            return "(" + s + r.choice(FINAL.get(lang, "...?")) + ")"
        s = self._up(space.join(parts), lang)
        end = r.choice(FINAL.get(lang, ".....!??"))
        if lang == "es" and end in "?!" and not s.startswith(("«", "“", '"')):
            s = {"?": "¿", "!": "¡"}[end] + s
        if lang == "fr" and end in "?!" and r.random() < 0.8:
            end = r.choice([" ", " ", "\xa0"]) + end
        if r.random() < 0.07:
            end = r.choice(["...", "…", " ...", " …", "?!", "!!", "??"])
        if r.random() < 0.06 and s[-1:] not in ".…":
            end += r.choice([f"[{r.randint(1, 60)}]", f"[{r.randint(1, 9)}, {r.randint(10, 60)}]", f"[{r.randint(1, 9)}-{r.randint(10, 20)}]"])
        return s.rstrip(",;:،，、") + end

    def _up(self, s: str, lang: str) -> str:
        if lang in FIRST and self.r.random() < 0.4:
            return self.r.choice(FIRST[lang]) + " " + s
        if lang not in _SPACELESS and self.r.random() < 0.4:
            # Many a first word is none of the common ones.
            rare = self.r.choice([self.proper(), self.word(True) + self.word(), self.r.choice(self.v[lang]) + self.r.choice(self.v[lang])])
            s = rare[:1].upper() + rare[1:] + " " + s
        return s if self.r.random() < 0.06 else s[:1].upper() + s[1:]


def labelled_texts(n: int, seed: int) -> list[tuple[str, list[int]]]:
    """``n`` texts with the offsets where their sentences end. Most are of one language; spaces within
    sentences are line breaks now and then; some sentences follow without a space."""
    r = random.Random(seed)
    w = Writer(r)
    assert vocabulary()
    out = []
    for _ in range(n):
        lang = r.choice(LANGS)
        text, ends = "", []
        count = r.randint(1, 9)
        wrapped = r.choice([0.0, 0.0, 0.05, 0.15])
        for k in range(count):
            if r.random() < 0.05 and lang != "th":
                lang = r.choice([x for x in LANGS if x != "th"])
            s = w.sentence(lang)
            if lang != "th":
                s = "".join("\n" if c == " " and r.random() < wrapped else c for c in s)
            text += s
            ends.append(len(text))
            if k + 1 < count:
                gaps = ["", "", "", "\n", "\n\n"] if lang in ("zh", "ja") else [" "] * 12 + ["\n", "\n", "\n\n", "\n\n", "  "] + ([] if lang == "th" or not s[-1] in ".!?])\"”»" else [""])
                gap = r.choice(gaps)
                text += gap
        if r.random() < 0.15 and lang != "th" and text[-1:] in ".!?":
            text = text[:-1] + r.choice(["", "", " …", " ..."])  # a rest without its final mark
            ends[-1] = len(text)
        out.append((text, ends))
    return out
