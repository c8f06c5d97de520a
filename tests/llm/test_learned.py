"""Held-out accuracy of the two trained models, and their defined results in odd cases."""

import re

from marginalia.llm import personal, sentences
from marginalia.llm.pii_training import labelled_sentences
from marginalia.llm.sentence_training import labelled_texts


def score(got, want):
    tp = sum(len(set(a) & set(b)) for a, b in zip(got, want, strict=True))
    return tp / max(1, sum(map(len, got))), tp / max(1, sum(map(len, want)))


def test_sentences_held_out():
    s = sentences.Splitter(sentences.trained())
    data = labelled_texts(600, 1234)
    p, r = score(s.ends([t for t, _ in data]), [e for _, e in data])
    assert p > 0.95 and r > 0.93


def ends(*texts):
    return sentences.Splitter(sentences.trained()).ends(list(texts))


def test_sentences_by_hand():
    t = 'He saw Dr. Weber at 9 a.m. on Oct. 3. The note "Stop it. Now!" was ignored.[4] Why? No mark at the end'
    assert [t[:e].rsplit(" ", 1)[-1] for e in ends(t)[0]] == ["3.", "ignored.[4]", "Why?", "end"]
    assert ends("温度高。为什么？") == [[4, 8]] and ends("", "  ", "a", "a.\n") == [[], [], [1], [2]]
    thai = "อุณหภูมิสูง แรงดัน 12 หน่วย"
    assert ends(thai) == [[11, len(thai)]]


#: Written by hand, with | behind each sentence: no text of the training generator, nor of the tables.
HAND = """He met Gen. Smith and Sen. Brown there.| They left early.|
The U.S. Navy came.| It left.|
Dr. Lee paid 3.50 dollars.| Prices rose by 4.2 % in Jan. 2020.| Why?| Nobody knows!|
“Is it over?” she asked.| He said nothing (it was late. Very late) and went home.|
J. R. Tolkien wrote it.[12]| See Fig. 3 and Eq. (4).| The file is notes.txt.|
Wir kamen am 3. Mai an.| Das kostet z. B. 20 Euro, d. h. zu viel.| Warum?|
Il arrive à 8 h 30.| Pourquoi ?| M. Dupont est là, p. ex. avec sa fille.|
¿Dónde está?| El Sr. Pérez llegó a las 3 p. m. y se fue.| ¡Qué bien!|
Он пришёл в 5 ч.| См. рис. 4 и т. д. для примера.| Почему?|
Ήρθε χθες.| Πού πήγε;| Δεν ξέρω.|
今天天气很好。|你去哪里？|他说：“走吧。”然后离开了。|
今日は晴れです。|どこへ行きますか？|
وصل أمس.| أين ذهب؟|
वह कल आया।| वह कहाँ गया?|
ሰላም ነው።| ደህና ነኝ።|
این خوب است۔| بله۔|"""


def test_sentences_by_hand_in_many_languages():
    lines = HAND.split("\n")
    texts = [x.replace("|", "") for x in lines]
    want = []
    for x in lines:
        at, out = 0, []
        for c in x:
            if c == "|":
                out.append(at)
            else:
                at += 1
        want.append(out)
    p, r = score(ends(*texts), want)
    assert p >= 0.9 and r >= 0.9, [(t, g, w) for t, g, w in zip(texts, ends(*texts), want, strict=True) if g != w]


def test_long_text_is_split_whole():
    t = "The valve opened. " * 5000
    assert len(ends(t)[0]) == 5000


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None), (3, ""), (None, "x."), (1, "One. Two.")], "id bigint, c string")
    rows = [tuple(r) for r in sentences.sentence_ends(df, "id", "c").collect()]
    assert sorted(rows) == [(1, 1, 4), (1, 1, 4), (1, 2, 9), (1, 2, 9)]
    assert sentences.sentence_ends(df.limit(0), "id", "c").count() == 0


def test_personal_held_out():
    f = personal.Finder(personal.trained())
    data = labelled_sentences(600, 4321)
    p, r = score(f.find([t for t, _ in data]), [s for _, s in data])
    assert p > 0.9 and r > 0.86


#: Written by hand, finds in <kind:...>: no sentence of the training patterns, nor of the tables.
FOUND = """Please contact Dr. <name:Rebecca Thornhill> at <email:rebecca.thornhill@gmail.com> or on <phone:+61 2 9374 4000>.
SSN: <id_number:123-45-6789>.
call <phone:(415) 867-5309> for <name:Giovanni Bellini>
Der Antrag von <name:Friederike Baumgartner> liegt vor.
Связаться: <name:Иван Петров>, <address:ул. Ленина 5, Москва>, <phone:+7 495 123-45-67>
联系人：<name:王伟>，电话：<phone:138 1234 5678>，身份证号：<id_number:110101199003071234>
The landlord at <address:12 Abbey Road, London NW8 9AY> never wrote back.
You can reach <name:Omar Haddad> by mail (<email:o.haddad@uni-koeln.de>) only.
The nurse, <name:Patricia O'Neill>, noted the passport number <id_number:KL1234567>.
<name:T. S. Whitfield> and <name:Harper, Daniel> were late; fax <phone:212-555-0147>.
Madame <name:Élodie Charpentier> habite <address:14, rue de la République, 69002 Lyon>.
El paciente <name:Álvaro Núñez> dio su DNI <id_number:12345678Z> y el correo <email:alvaro_nunez@correo.es>.
Herr <name:Jürgen Großmann> wohnt <address:Goethestraße 8a, 60313 Frankfurt>.
write to support [at] acme [dot] org
Lunch was at the Grand Hotel in Vienna. The Bessel function of Smith et al. (2019) has order 12.
The meeting of the World Health Organization starts at 10:30 on 2021-04-05 in Room 204.
Prof. Keller disagreed; version 2.10.4 of model.bin has 1234567 rows.
Serial 4711-0815-99 failed at 3.7 kV. ISBN 978-3-16-148410-0 is out of print."""


def test_personal_by_hand():
    f = personal.Finder(personal.trained())
    texts, want = [], []
    for line in FOUND.replace("support [at] acme [dot] org", "<email:support [at] acme [dot] org>").split("\n"):
        text, spans = "", []
        for part in re.split(r"(<\w+:[^>]*>)", line):
            m = re.fullmatch(r"<(\w+):([^>]*)>", part)
            if m:
                spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2] if m else part
        texts.append(text)
        want.append(spans)
    got = f.find(texts)
    p, r = score(got, want)
    wrong = [(t, [t[a:b] for a, b, _ in g], [t[a:b] for a, b, _ in w]) for t, g, w in zip(texts, got, want, strict=True) if sorted(g) != sorted(w)]
    assert p >= 0.85 and r >= 0.85, (p, r, wrong)


def test_pieces_of_long_texts_agree_with_the_whole(monkeypatch):
    f = personal.Finder(personal.trained())
    texts = ["  ".join(t for t, _ in labelled_sentences(40, 5)), "word " * 3000 + "My name is Anna Keller. " + "word " * 3000]
    whole = f.find(texts)
    monkeypatch.setattr(personal, "PIECE", 150)
    monkeypatch.setattr(personal, "LAP", 100)
    cut = f.find(texts)
    assert cut[1] == whole[1] and len(set(cut[0]) ^ set(whole[0])) <= 2


def test_personal_table_and_mask(spark):
    t = "We report nothing. Author note: Mirthe Oskrin, ID ZZ1074456, phone +49 (0)30 23125-199. As Holsson et al. said."
    df = spark.createDataFrame([(1, t), (2, None), (3, ""), (None, t), (4, "word " * 20000 + t)], "doc_id bigint, text string")
    rows = personal.find_personal(df, "doc_id", "text").collect()
    one = {(r.kind, t[r.start_pos - 1 : r.end_pos]) for r in rows if r.id == 1}
    assert one == {("name", "Mirthe Oskrin"), ("id_number", "ZZ1074456"), ("phone", "+49 (0)30 23125-199")}
    assert {r.id for r in rows} == {1, 4} and sum(r.id == 4 for r in rows) == 3
    masked = [r.masked for r in personal.masked_text(df, "text").collect()]
    assert masked[0] == "We report nothing. Author note: [NAME], ID [ID_NUMBER], phone [PHONE]. As Holsson et al. said." and masked[1] is None and masked[2] == ""
    assert personal.find_personal(df.limit(0), "doc_id", "text").count() == 0


def test_runs_inside_are_decoded_as_whole_texts():
    f = personal.Finder(personal.trained())
    texts = [t for t, _ in labelled_sentences(300, 77)] + ["", " ", "\n", " \n\t", "a  \n", "٣12 and 12٣, ก๓12"]
    got = f.find(texts)
    for t, found in zip(texts, got, strict=True):
        ids = f.tokens.of(t)
        if not len(ids):
            assert found == []
            continue
        em = personal._emissions(f.table, personal.np.pad(ids, personal.REACH)[None])
        tags = personal.decode(em, personal.np.array([len(ids)]), f.trans)[0]
        assert found == sorted(personal._spans(t, f.tokens.places(t), tags, 0, len(ids))), t


def test_only_runs_that_may_be_inside_are_decoded(monkeypatch):
    f = personal.Finder(personal.trained())
    decoded, plain = [], personal.decode
    monkeypatch.setattr(personal, "decode", lambda em, n, trans: decoded.append(int(n.sum())) or plain(em, n, trans))
    text = "The surface of the sample was heated and the pressure rose slowly. " * 200 + "Contact: Anna Keller, +49 30 2312519."
    assert [k for _, _, k in f.find([text])[0]] == ["name", "phone"]
    assert sum(decoded) < 300


def test_numbers_that_make_the_same_features_are_one_token():
    f = personal.Finder(personal.trained())
    a, b = f.tokens.of("see DN-48213 and 7310.5"), f.tokens.of("see DN-45557 and 7999.5")
    assert a.tolist() == b.tolist()
    # Stretches as before: what is spaced, and where tokens are.
    t = personal.Tokens(f.common)
    t.of(" a\n b  \nc\t")
    assert t.places(" a\n b  \nc\t") == [(1, 2), (2, 3), (4, 5), (7, 8), (8, 9)]
    assert [k[:2] for k in t.ids][1:] == [("a", True), ("\n", False), ("b", True), ("\n", True), ("c", False)]
