"""A small labelled table of texts with and without personal information, of invented material.

``<kind>`` in a pattern is filled with such a find: name, email, phone, id_number, address. Names and addresses are those of
the pattern's language, now and then of another one. Other fillers: {s} a surname alone, {w} {W} a word, {T} a town, {n} a number,
{d} a small one, {c} a code, {u} a unit, {r} a run of digits that means nothing. Names,
towns and streets were made up for this table; formats are public standards of many countries, filled at random. Some patterns
were added for what an earlier model found in the test tables and this one missed, with their words replaced by random ones.
"""

from __future__ import annotations

import base64
import random
import re
from functools import lru_cache
from pathlib import Path

from marginalia.llm.bpe import TOKENIZERS

PATTERNS: dict[str, list[str]] = {
    "en": [
        "Contact <name> on <phone> or by email: <email>.", "Please call <phone> and ask for <name>.", "My name is <name> and I live at <address>.", "Send the parcel to <name>, <address>, by Monday.", "Dear Mr. <name>, your passport number <id_number> was received.", "Signed: <name> (<email>).", "{W} <name>, ID <id_number>, {w}.", "The {w} of ID <id_number> {w} the {w}.", "{W} {w} passport no. <id_number>, {w}.", "{w} {w} national ID <id_number> {w} {w}.", "identity no. <id_number>, phone <phone>", "{W} {w} at <address> and {w} {w}.", "{W} {w} {w} to <address> {w} {w}.", "{W} {w} {w}, <address>.", "{W}: <address>. {W} {w}.", "Mail: <email> / <phone> {W} {w} {w}.", "{W} {w} (<email>, Tel. <phone>). {W} {w}.",
        "Mrs <name> of <address> reported it.", "The applicant, <name>, gave her social security number as <id_number>.", "SSN: <id_number>", "ID: <id_number>, name: <name>", "For details write to <email>.", "Reach me at <phone>.", "Tel: <phone>, fax: <phone>", "Email <email> or phone <phone> before noon.",
        "<name> was born in {T}.", "{w} {w}. <name> said that the {w} {w} the {w}.", "Thanks to <name>, <name> and <name> for their help with the {w}.", "We are grateful to <name> and <name>.", "Prof. <name> and Dr <name> checked the {w}.", "The letter from <name> ({T}) arrived.", "Photo by <name>.", "Author: <name>\nEmail: <email>",
        "Interview with <name> at <address>.", "Ship it to <address>.", "Our office moved to <address> last year.", "<name> lives at <address> and can be called at <phone>.", "The tenant of <address> paid.", "Her home address is <address>.", "Driver licence <id_number> belongs to <name>.", "National insurance no. <id_number> was checked.",
        "The patient (<name>, ID <id_number>) left.", "Volunteer <name>, identity card <id_number>, agreed.", "Invoice for <name>: tax number <id_number>.", "questions? <email>", "Please forward this to <name> <<email>>.", "call <phone> for <name>", "Ask <name> at <email> about the {w} {w}.", "Speak to <name>; her number is <phone>.", "The {w} was seen by <name> near {T}.",
        "Samples were packed by <name> and sent to {T}.", "Report by Ms. <name>, approved by Mr. <name>.", "Correspondence: <name>, <address>. Tel. <phone>.", "<name>'s phone is <phone>.", "Refund of {n} to ID number <id_number> is done.", "Bring the boxes to <address>, please.", "<name> (phone <phone>) keeps the {w}.", "Supervisor: <name>. {W} {w} {w}.", "As <name> wrote at {d} p.m. on Mar. {d}, the {w} {w}.",
    ],
    "de": [
        "Bitte wenden Sie sich an <name> unter <phone>.", "Frau <name> wohnt in der <address>.", "Herr <name>, Ausweisnummer <id_number>, hat unterschrieben.", "E-Mail: <email>, Telefon: <phone>", "Steuernummer <id_number>, {w} für <name>.", "Die {W} {w} an <name>, <address>.", "Erreichbar {w} <phone> und <email>.", "Die Pakete sind an <name>, <address>, zu schicken.", "Mein Name ist <name>.", "Besonderer Dank gilt <name> und <name>.", "Die Steuernummer lautet <id_number>.",
        "Lieferadresse: <address>", "Fragen beantwortet <name> (<email>).", "Zeugin: <name>, Reisepass <id_number>.", "Rufen Sie <phone> an.", "Dr. <name> prüfte die {W} in {T}.", "Kontakt über <email> oder <phone>.", "Der Bericht stammt von <name>.", "Ausweis <id_number>, gehört Frau <name>.", "Identifikationsnummer <id_number> für <name>",
    ],
    "fr": [
        "Veuillez contacter <name> au <phone>.", "Madame <name> habite au <address>.", "M. <name>, passeport n° <id_number>, a signé.", "Courriel : <email>, tél. <phone>", "Tél. : <phone>, adresse <email>.", "Identité : <id_number>, au nom de <name>.", "{W} {w} à <name>, <address>.", "Les colis partent chez <name>, <address>.", "Je m'appelle <name>.", "Merci à <name> et à <name> pour leur aide.", "Numéro de sécurité sociale : <id_number>", "Adresse : <address>.",
        "Écrire à <name> (<email>).", "Le rapport de <name> est arrivé à {T}.", "Carte d'identité <id_number> de <name>.", "Appelez le <phone>.", "Le numéro <id_number> est celui de <name>.",
    ],
    "es": [
        "Contacte con <name> en el <phone>.", "La señora <name> vive en <address>.", "Don <name>, con DNI <id_number>, aceptó.", "La {w} <name>, con documento <id_number>, {w}.", "{W} {w}, documento nacional <id_number>.", "Teléfono <phone>; correo <email>.", "{W} {w} a <name>, <address>.", "Correo: <email>, teléfono <phone>", "Enviar el paquete a <name>, <address>.", "Me llamo <name>.", "Gracias a <name> y a <name> por la ayuda.", "Pasaporte <id_number> de <name>.", "Dirección: <address>.", "Escriba a <name> (<email>).", "El informe de <name> llegó a {T}.",
        "El voluntario <name>, con identificación <id_number>, firmó ayer.", "Llame al <phone>.",
    ],
    "ru": [
        "Обращайтесь к <name> по телефону <phone>.", "Меня зовут <name>.", "Почта: <email>, тел. <phone>", "<name> проживает по адресу: <address>.", "Паспорт <id_number> выдан: <name>.", "Отчёт подготовил <name>.", "Спасибо <name> и <name> за помощь.", "Адрес доставки: <address>", "Связаться: <name>, <address>, <phone>", "Пишите на <email>.", "Звоните: <phone>.", "ИНН <id_number>, <name>",
    ],
    "el": ["Επικοινωνήστε με τον <name> στο <phone>.", "Με λένε <name>.", "Διεύθυνση: <address>", "Ηλ. ταχυδρομείο: <email>, τηλ. <phone>", "Ταυτότητα <id_number>, <name>.", "Ευχαριστούμε την <name> και τον <name>.", "Γράψτε στο <email>."],
    "zh": ["联系人：<name>，电话：<phone>。", "请联系<name>，邮箱：<email>。", "<name>先生住在<address>。", "身份证号：<id_number>，姓名：<name>。", "地址：<address>。", "如有问题请发邮件至<email>。", "请拨打<phone>。", "邮箱：<email>，电话：<phone>。", "邮箱：<email>（电话 <phone>）。", "{q}{q}请打 <phone> 。", "感谢<name>和<name>的帮助。", "申请人<name>（身份证<id_number>）已签字。", "收件人：<name>，<address>，电话<phone>。"],
    "ja": ["担当者：<name>、電話：<phone>。", "<name>さんは<address>に住んでいます。", "メール：<email>、電話 <phone>", "氏名：<name>、番号：<id_number>。", "住所：<address>。", "お問い合わせは<email>まで。", "<name>氏と<name>氏に感謝する。", "電話番号は<phone>です。", "連絡：<email>（電話 <phone>）。", "電話（<phone>）", "マイナンバー <id_number>"],
    "ar": ["للتواصل مع <name> على <phone>.", "اسمي <name>.", "البريد: <email>، هاتف <phone>", "رقم الهوية <id_number> باسم <name>.", "العنوان: <address>.", "نشكر <name> و <name>.", "اتصل على <phone>."],
    "hi": ["<name> से <phone> पर संपर्क करें।", "मेरा नाम <name> है।", "ईमेल: <email>, फ़ोन <phone>", "पता: <address>।", "आधार संख्या <id_number>, नाम <name>।", "हम <name> और <name> के आभारी हैं।"],
    "th": ["ติดต่อ คุณ<name> โทร <phone>", "ชื่อ นาย<name>", "อีเมล: <email> โทร <phone>", "ที่อยู่ <address>", "เลขประจำตัว <id_number> ชื่อ นาง<name>", "ขอบคุณ นางสาว<name>"],
}
#: Words for people and for their papers, by language.
ROLES = {
    "en": "Participant Volunteer Respondent Witness Applicant Engineer Technician Student Director Patient Customer Nurse Driver Member Author Editor Colleague Neighbour".split(),
    "de": "Teilnehmerin Teilnehmer Zeuge Antragsteller Ingenieurin Studentin Direktor Patient Kundin Autor Kollege Antrag".split(),
    "fr": "Participante Témoin Ingénieur Étudiante Directeur Patiente Client Auteur Collègue".split(),
    "es": "Participante Testigo Ingeniero Estudiante Director Paciente Cliente Autora Colega".split(),
}
PAPERS = {
    "en": ["passport no.", "passport number", "ID", "ID no.", "national ID", "identity card", "social security number", "SSN", "tax number", "driving licence", "identity number", "national insurance number"],
    "de": ["Reisepass", "Personalausweis", "Ausweisnummer", "Steuernummer", "Identifikationsnummer", "Sozialversicherungsnummer", "Steuer-Nr."],
    "fr": ["passeport n°", "carte d'identité", "numéro de sécurité sociale", "n° d'identité", "pièce d'identité"],
    "es": ["documento de identidad", "DNI", "NIE", "pasaporte", "carné de identidad", "número de identidad"],
}
_PEOPLE = ["{R} <name>, {P} <id_number>, {w} the {w}.", "{R} <name> {w} the {w} {w}.", "The {w} {R} <name> ({P} <id_number>) {w}.", "{P} <id_number>, {w} <name>.", "{R}: <name>, {P} <id_number>, tel. <phone>.", "{W} {w} {P} <id_number> {w} {w}.", "{R} <name> (tel. <phone>) {w} the {w}.", "{R} <name>, {w} {P} <id_number>, {w}."]
#: Patterns of any words around a name, so that the words of the others aren't what tells one.
AROUND = {
    "en": ["{W} <name> {w} the {w}.", "{W} <name>, {w} {w}, {w} the {w}.", "The {w} {w} <name> {w} {w}.", "{W} {w} {w} to <name>, {d} {w}.", "{W} {w} {w} to <name>, <address>.", "{W} {w} <name>, <address>. {W} {w}.", "{W} {w} <name> and <name> {w} {w}.", "We {w} <name> and <name>.", "{W} {w} by Dr. <name>; {w} {w} <email>.", "{W} {w} <name> at <email>.", "<name> {w} {w} the {w} {w}.", "{W} {w} <name> and <name> {w} {w} the {w}.", "{w} {w} by Dr. <name>; {w} {w}.", "{W}: <name>, {W} {d}, {w} {w}.", "{W} {w} {w} {w} <name> at {w} {w}.", "{W} <name> {w} {w} and Prof. <name> {w} {w}.", "{W} {w} {w} {w} {w} {w} <name>.", "<name> ({w}. {d}) {w} the {w} {w}.", "{W} {w} <name> ({w}), {w}.", "{W}: <name>. {W}: {n} {u}.", "Mr <name> {w} {w}. Ms <name> {w}.", "{W} {w} to <name>: {w} {w}.", "{W} {w}, {w} {w} <name>."],
    "de": ["{W} <name> {w} die {W}.", "Die {W} {w} an <name>, {W} {d}.", "{W} {w} <name> für die {W}.", "<name> {w} {w} und {w}.", "{W} {w} {w}, {w} für <name>.", "{W} an <name> ({w}).", "Wir {w} <name> und <name>."],
    "fr": ["La {w} <name> {w} le {w}.", "{W} {w} à <name>, {d} {w}.", "Nous {w} <name> et <name>.", "{W} {w}, au {w} de <name>.", "{W} <name> à {w} {w}.", "<name> {w} le {w} {w}."],
    "es": ["La {w} <name>, con {w} {w}, {w}.", "{W} {w} a <name> su {w}.", "{W} a <name>, {w} {d}.", "Para {w}, <name> ({w}).", "<name> {w} la {w}."],
    "ru": ["{Q}: <name>, {q}.", "{Q} {q} <name> {q}.", "<name> {q} {q}."],
    "el": ["{Q}: <name>, {q}.", "Ο <name> {q} την {q}."],
}
#: Texts that hold nothing, by language.
PLAIN: dict[str, list[str]] = {
    "en": [
        "The {w} {w} of the {w} was {n} {u} in {T}.", "As {s} et al. wrote, the {w} {w}.", "Dr. {s} and Ms. {s} disagreed.", "Prof. {s}. Please read the {w}.", "{W} {w}, per Dr. {s} and Prof. {s}. {W} {w} the {w}.", "The {w} {w} at {n} {u}. {W} {w} {w}.", "{W} {w} i.e. {n} {u} vs. {n} {u}. {W} {w}.", "{w} {w} beyond {n} W, where {w}.", "Die {w} {W}. {W} {w}.", "{W} {w} [{d}]. {W} {w} {w} the {w}.", "{W} {w} {w} Flat {d} of the {w}.", "{s} ({y}) found no {w}.", "{s} and {s} ({y}) found {d} of them.", "The {s}–{s} test fails below {n} {u}.", "The {s} method was used on the {s} data.", "{T} Journal of {W} {W}, Vol. {d}, No. {d}.",
        "The University of {T} and the {T} Institute of {W} took part.", "Figure {d} and Table {d} show {W} {w}.", "{W} {W} and {W} {W} are companies.", "In {T} and {T}, {w} {w} was rare.", "Order {r} was shipped.", "Serial number {r} was printed on it.", "ISBN {r}", "See doi:{d}.{r}/{w}.{d}.", "doi:10.{r}/a{d}.{r}.{r}", "Grant no. {r} covered it.", "Project {r}, lot {r}, batch {r}.", "The archive at 10.{d}.{d}/{w}.{r}.{r} is public.", "Version {d}.{d}.{d} of {w}{d}.csv was run at {d}:{d}{d} on {y}-{d}-{d}.", "Pages {r}-{r}, lines {r} to {r}.", "Pages {r}-{r} {w} {r} {w} {w}.", "{W} {r}-{r} {w} {r}.",
        "The decorator @{w} and the handle @{w}_{w} are fine.", "{n} {u} @ {d} Hz for {r} runs.", "Room {d}, Building {d}, opens at {d} a.m.", "{T} Street was closed; {d} {w} stones were found on {T} Road.", "The {w} {w} near {T} Lane is old.", "Sample {c} shows {w} {w} ({n} {u}).", "Codes {r}, {r} and {r} were dropped.", "Stamp {r}-{r} marks it.", "Copy {r} was lent to reader {r} on day {r}.", "No. {d} {W} St. is closed.",
        "Although the {w} {w}, the {w} {w} the {w}.", "Why does the {w} {w}? Because {w} {w} {w}.", "However, {W} {w} data and {w} data agree to {n} %.", "{W}, {W} and {W} are {w}.", "He met Mr. {s} there. They {w} the {w}.", "\"The {w} {w}. Do {w}!\" said the {w} of {c}.", "Moreover, in the {w} {w}, each {w} {w} [{d}, {d}-{d}].", "e.g. St. {T} ... or the {w} there", "cf. Sect. {d}.{d} and Eq. ({d})", "The {W} cell with serial {r} broke.", "A {s} {w} with {w} {r} was {w}.", "A {s} {w}, {w} and {w}.", "An {s} {w} {w} {w}.", "{w} {w}. A {s} {w} of {n} {u} {w}.", "E = {n} {u}. J = {d}. {W} {w}.", "\\\\alpha = {n} and \\\\frac{{n}}{{d}} = E {W} {w} {w}.", "In the U.S. {W} {w} {w}. In the U.K. {W} {w}.",
        "A {w}, {w} and {w}. {W} {w} {w} {w} {n} {u}.", "Chapter {d}\n\n{W} {w} {w}\n\nThe {w} {w}.", "{w} = [[{d}, {d}], [{d}, null]]", "====\n{W} {w}\n----", "Saint {W} Day is a feast in {T}.", "Lake {T} and Mount {T} are in {W} County.", "The {y} {T} Conference on {W} {W} was held.", "up to {r} users and {n} {u}.", "The ratio {d}/{d}/{d} and the range {n}-{n} {u}.",
        "{s}, {s} and {s} gave other numbers.", "The {W} of {W} {w} {w}.", "J {n} {u}, K {n} {u}.", "No {w} {w} {w}. {T} {w} it.", "Our {W} Team works on {W} Science.",
    ],
    "de": ["Die {W} der {W} {w} bei {n} {u} (vgl. Abb. {d}).", "Nach Dr. {s} {w} die {w} {W} Nr. {d}.", "Am {d}. Oktober {y} wurde die {W} {c} gemessen, d. h. die {W} {w}.", "Die {T}er Zeitschrift für {W} und {W}, Bd. {d}.", "Prof. {s} und Frau {s} {w}. Die {W} {w} z. B. die {W}.", "Im Protokoll {c} steht „Die {W} {w}. Bitte {w}!“ neben {n}.", "Bestellung {r} und Vorgang {r} sind fertig.", "Warum {w} die {W}? Der {W} {w} ca. {n} {u}."],
    "fr": ["La {w} {w} de {c} vaut {n} {u} (cf. fig. {d}).", "Selon M. {s}, une {w} {w} {w}.", "L'Université de {T} et l'Institut {W} ont participé.", "Pourquoi la {w} {w} ? Cette {w} {w}, p. ex. à {n} {u}.", "La note {c} « La {w} {w}. {W} ! » suit.", "Commande {r} du {d} mai {y}.", "Mme {s} et le Pr {s} sont absents."],
    "es": ["La {w} {w} de {c} vale {n} {u} (véase la fig. {d}).", "Según el Dr. {s}, una {w} {w}.", "¿Por qué la {w} {w}? ¡La {w} {w} con {n} {u}!", "La Universidad de {T} y el Instituto {W}.", "El pedido {r} llegó el {d} de mayo de {y}.", "El Sr. {s} y la Sra. {s} no vinieron."],
    "ru": ["{Q} {q} {q} {c} равна {n}.", "Почему {q} {q}, если {q} равна {n}?", "По данным г. {Q}, {q} {q}.", "Университет города {Q} и институт {q}.", "В журнале «{Q} {q}. {Q}!» указано {r}."],
    "el": ["Η {q} {q} του {c} είναι {n}.", "Γιατί η {q} {q} την {q};", "Κατά τον κ. {Q}, η {q} {q}."],
    "zh": ["编号{c}的{q}在{n}时{q}{q}。", "为什么{q}会{q}{q}？", "{q}大学和{q}研究所参加了会议。", "记录写着“{q}{q}。请{q}！”并注明{r}。", "王教授说{q}。"],
    "ja": ["{c}の{q}は{n}のとき{q}を{q}。", "なぜ{q}は{q}のか？", "{q}大学と{q}研究所が参加した。", "佐藤教授は{q}と言った。", "記録には「{q}は{q}。」とあり{r}である。"],
    "ar": ["وفق د. {Q} {q} {q} إلى {n}.", "لماذا {q} {q} {c} قيمة {q}؟", "جامعة {Q} ومعهد {q}."],
    "hi": ["डॉ. {Q} के अनुसार {q} {q} {c} {n} है।", "क्या {q} {q} को {q} करती है?", "{q} विश्वविद्यालय और {q} संस्थान।"],
    "th": ["{q}{q}ของ{c}{q} {n} หน่วย", "{q}มหาวิทยาลัย{q}และ{q}"],
}
#: Common first and family names of many countries.
GIVEN = {
    "en": "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Thomas Jessica Charles Karen Daniel Nancy Matthew Lisa Anthony Margaret Mark Sandra Paul Ashley Steven Emily Andrew Donna Kevin Carol Brian Amanda George Melissa Rebecca Laura Giovanni Lucia Priya Chen Fatima Omar Olga Ingrid Sven".split(),
    "de": "Hans Anna Peter Ursula Klaus Monika Jürgen Petra Wolfgang Sabine Uwe Renate Dieter Friederike Lukas Lena Jonas Mia Günther Käthe Björn Heike Matthias Änne".split(),
    "fr": "Jean Marie Pierre Nathalie Michel Isabelle Philippe Sylvie Alain Catherine Luc Françoise Étienne Chloé Léa Hugo René Zoé Benoît Hélène Élodie Gérard".split(),
    "es": "José María Antonio Carmen Manuel Ana Francisco Isabel Javier Dolores Jesús Lucía Ángel Rocío Álvaro Inés Óscar Begoña Iván Nuria".split(),
    "ru": "Иван Анна Сергей Ольга Дмитрий Елена Алексей Наталья Андрей Мария Пётр Ирина Николай Татьяна Олег Юлия".split(),
    "el": "Γιώργος Μαρία Κώστας Ελένη Νίκος Κατερίνα Δημήτρης Σοφία Αλέξανδρος Άννα".split(),
    "ar": "محمد فاطمة أحمد عائشة علي مريم خالد ليلى حسن زينب يوسف سارة".split(),
    "hi": "राम सीता अमित प्रिया राहुल नेहा विकास सुनीता अनिल कविता मोहन पूजा".split(),
    "th": "สมชาย สมหญิง ประเสริฐ มาลี วิชัย สุดา ณรงค์ อรทัย".split(),
}
FAMILY = {
    "en": "Smith Johnson Williams Brown Jones Garcia Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Hall Young King Wright Scott Green Baker Adams Nelson Hill Bellini O'Brien McDonald Thornhill".split(),
    "de": "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Baumgartner Groß Öztürk".split(),
    "fr": "Martin Bernard Dubois Durand Moreau Laurent Lefèvre Leroy Roux Fournier Girard Bonnet Lambert François Mercier Béranger Noël".split(),
    "es": "García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Ruiz Díaz Moreno Muñoz Álvarez Romero Núñez".split(),
    "ru": "Иванов Смирнова Кузнецов Попова Соколов Лебедева Козлов Новикова Морозов Петров Волков Сидорова".split(),
    "el": "Παπαδόπουλος Γεωργίου Νικολάου Δημητρίου Οικονόμου Ιωάννου Βασιλείου".split(),
    "ar": "الحسن إبراهيم العلي منصور الشمري حداد خوري ناصر".split(),
    "hi": "शर्मा वर्मा गुप्ता सिंह कुमार पटेल यादव मिश्रा".split(),
    "th": "ใจดี สุขสวัสดิ์ ทองคำ ศรีสุข แสงจันทร์ วงศ์ดี".split(),
}
_ZH_FAMILY, _ZH_GIVEN = "王李张刘陈杨黄赵周吴徐孙马朱胡林郭何高罗郑梁谢宋唐许邓韩冯曹", "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华建文宇浩欣雨梓轩"
_JA_FAMILY, _JA_GIVEN = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本".split(), "太郎 花子 一郎 健 美咲 翔 陽子 直樹 真由美 大輔 恵子 誠 愛 由美子".split()
_WORDS = {
    "ru": "проба плотность среда реакция вязкость решётка повышает меняет слабая нагрузка город страна вода время работа".split(),
    "el": "πίεση δομή υψηλή μειώνει στρώση υπόθεση θερμική πόλη νερό χρόνος".split(),
    "zh": "温度 模型 样本 提高 稀疏 界面 压力 弹性 频率 土壤 城市 时间 工作 数据 结果 方法".split(),
    "ja": "温度 界面 モデル 溶液 下げる 複合的 信号 時間 仕事 結果 方法 データ 都市".split(),
    "ar": "العينة تربة قياس سطح يزيد التردد مدينة ماء زمن عمل نتيجة".split(),
    "hi": "औसत परत नमूना मिट्टी घनत्व उच्च शहर पानी समय काम परिणाम".split(),
    "th": "ดิน อุณหภูมิ แรงดัน ความถี่ เพิ่ม ลด น้ำ เวลา งาน ผลลัพธ์".split(),
}
#: Letters of scripts without capitals: words of any of them are no names for being unknown.
_LETTERS = {"zh": (0x4E00, 0x9FA5), "ja": (0x4E00, 0x9FA5), "hi": (0x0905, 0x094C), "ar": (0x0621, 0x064A), "th": (0x0E01, 0x0E30)}
_STREETS = {
    "en": "Street Road Lane Avenue Drive Close Court Way Place Boulevard St. Rd. Ave Ave. Terrace Square Hill Gardens Crescent".split(),
    "de": "straße weg allee gasse platz ring ufer".split(),
    "fr": "rue avenue boulevard place chemin allée impasse quai route square cours".split(),
    "es": "Calle C/ Avenida Avda. Plaza Paseo Camino Ronda Travesía".split(),
}


@lru_cache(maxsize=1)
def vocabulary(folder: str = TOKENIZERS) -> dict[str, list[str]]:
    """Common words by language, from the public tokenizers' vocabularies: whole tokens of letters, those with a space before
    them where the script has spaces. Without the files, the few words above."""
    scripts = {"ru": "[а-яё]{3,}", "el": "[α-ωά-ώ]{3,}", "ar": "[\u0621-\u064a]{3,}", "hi": "[\u0900-\u0963]{3,}", "th": "[\u0e01-\u0e4e]{3,}", "ja": "[\u3040-\u30ff]{1,6}|[\u4e00-\u9fff]{2}", "zh": "[\u4e00-\u9fff]{1,3}"}
    out: dict[str, list[str]] = {"en": [], "de": [], **{k: list(v) for k, v in _WORDS.items()}}
    for file, langs in (("byte_bpe_50k.tiktoken", ("en",)), ("byte_bpe_multi_50k.tiktoken", ("de", *scripts))):
        path = Path(folder) / file
        if not path.is_file():
            continue
        for line in path.read_bytes().splitlines():
            try:
                t = base64.b64decode(line.split()[0]).decode()
            except (ValueError, IndexError):
                continue
            if t[:1] == " " and re.fullmatch("[a-zà-öø-ÿß]{2,}", t[1:]):
                out[langs[0]].append(t[1:])
            for k in langs[1:]:
                if re.fullmatch(scripts[k], t.strip()):
                    out[k].append(t.strip())
    out["fr"] = out["es"] = out["de"]
    return {k: sorted(set(v)) for k, v in out.items()}


def common_words() -> frozenset[str]:
    """Words that are written with small letters somewhere; names hardly are."""
    v = vocabulary()
    return frozenset(v["en"]) | frozenset(v["de"]) | frozenset(v["ru"]) | frozenset(v["el"])


class Maker:
    """Fills patterns with invented material."""

    def __init__(self, r: random.Random) -> None:
        self.r, self.v = r, vocabulary()

    def prose(self, lang: str, *, find: str | None = None, spans: list | None = None, at: int = 0) -> str:
        """A sentence of common words with numbers, codes, signs and proper names among them; with ``find`` one such find
        somewhere in it, whose place goes to ``spans``."""
        r, out, space = self.r, "", "" if lang in ("zh", "ja", "th") else " "
        n = r.randint(4, 22)
        where = r.randrange(n) if find else -1
        for i in range(n):
            w = r.choice(self.v[lang]) if lang not in _LETTERS or r.random() < 0.6 else "".join(chr(r.randint(*_LETTERS[lang])) for _ in range(r.randint(1, 3) if lang in ("zh", "ja") else r.randint(2, 8)))
            k = r.random()
            if k < 0.05:
                w = self.filler("n", lang) + " " + self.filler("u", lang)
            elif k < 0.09:
                w = self.filler("c", lang)
            elif k < 0.12:
                w = r.choice(["(" + w + ")", "“" + w + "”", '"' + w + '"', "[" + str(r.randint(1, 60)) + "]", "(see Fig. " + str(r.randint(1, 9)) + ")", w + "-" + r.choice(self.v[lang]), "e.g.", "i.e.", "cf.", "No. " + str(r.randint(1, 90))])
            elif k < 0.15:
                w = self.proper() if r.random() < 0.6 else w.capitalize()
            elif k < 0.165:
                w = self.filler("r", lang)
            elif k < 0.17:
                w = r.choice(["".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 40]))), self.shaped("a#a#a#a#a#a#"), f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"10.{self.digits(5)}/{self.word()[:2]}.{self.digits(3)}.{self.digits(4)}"])
            if i == 0 and lang not in ("zh", "ja", "th", "ar", "hi"):
                w = w[:1].upper() + w[1:]
            if i == where:
                # Scripts without capitals tell a name by its cue only, so none stands in running text.
                of = r.choice(["en", "de", "fr", "es"]) if lang in ("zh", "ja", "ar", "hi", "th") or r.random() < 0.2 else lang
                got = getattr(self, find)(of)
                spans.append((at + len(out) + (len(space) if out else 0), at + len(out) + (len(space) if out else 0) + len(got), find))
                w = got
            out += (space if out else "") + w
            if r.random() < 0.06 and i + 1 < n:
                out += r.choice([",", ",", ";", ":"]) if space or r.random() < 0.3 else "，"
        return out + ({"zh": "。", "ja": "。", "hi": "।"}.get(lang, "") if lang in ("zh", "ja", "hi") else "" if lang == "th" else r.choice([".", ".", ".", ".", "?", "!"]))

    def digits(self, k: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(k))

    def shaped(self, form: str) -> str:
        """A form with # for digits, A for capitals, a for small letters."""
        r = self.r
        return "".join(str(r.randint(0, 9)) if c == "#" else r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") if c == "A" else r.choice("abcdefghijklmnopqrstuvwxyz") if c == "a" else c for c in form)

    def word(self, cap: bool = False) -> str:
        r = self.r
        w = "".join(r.choice("b c d f g h l m n p r s t v st tr pr pl gr cl".split()) + r.choice("a e i o u y io ea ou".split()) for _ in range(r.randint(1, 4))) + r.choice(["", "n", "r", "s", "t", "l", "tion", "ment", "ing", "ed", "ly", "ous", "al", "ive"])
        return w.capitalize() if cap else w

    def proper(self) -> str:
        """A name-like word of any language written in Latin letters."""
        r = self.r
        parts = [r.choice("b br c ch d dr f fr g gr h j k kl kr l m n o p q qu r s sch sh st t th tr u v w wh x y z å é í ö".split()) + r.choice("a e i o u a e i o u a e i o u ae ei ie ou y á é í ó ö ü ä å".split()) + r.choice(["", "", "l", "n", "r", "s", "m", "k", "ll", "rr", "nd", "rt"]) for _ in range(r.choice([1, 2, 2, 2, 3]))]
        return ("".join(parts) + r.choice(["", "", "a", "o", "e", "n", "s", "son", "sen", "er", "man", "ton", "ski", "ova", "ini", "ez", "es", "ard", "ine", "is", "us", "el", "le", "berg", "field", "well"])).capitalize()

    def given(self, lang: str) -> str:
        r = self.r
        if lang in ("ru", "el", "ar", "hi", "th"):
            return r.choice(GIVEN[lang])
        return r.choice(GIVEN[r.choice(["en", "de", "fr", "es"]) if r.random() < 0.3 else lang if lang in GIVEN else "en"]) if r.random() < 0.35 else self.proper()

    def family(self, lang: str) -> str:
        r = self.r
        if lang in ("ru", "el", "ar", "hi", "th"):
            return r.choice(FAMILY[lang])
        return r.choice(FAMILY[r.choice(["en", "de", "fr", "es"])]) if r.random() < 0.25 else self.proper()

    def name(self, lang: str) -> str:
        r = self.r
        if lang == "zh" and r.random() < 0.6:
            return r.choice(_ZH_FAMILY) + "".join(r.choice(_ZH_GIVEN) for _ in range(r.choice([1, 2, 2])))
        if lang == "ja" and r.random() < 0.6:
            return r.choice(_JA_FAMILY) + r.choice(["", "", " "]) + r.choice(_JA_GIVEN)
        if lang in ("ru", "el", "ar", "hi", "th") and r.random() < 0.6:
            g, f = self.given(lang), self.family(lang)
            return r.choice([f"{g} {f}", f"{g} {f}", f"{f} {g}" if lang == "ru" else f"{g} {f}", f"{g[0]}. {f}" if lang in ("ru", "el") else f"{g} {f}"])
        g, f = self.given(lang), self.family(lang)
        if r.random() < 0.12:
            f += "-" + self.family(lang)
        if r.random() < 0.06:
            g += "-" + self.given(lang)
        if r.random() < 0.1:
            f = f.upper()
        i = lambda: r.choice("ABCDEFGHIJKLMNOPRSTUVWYZÉÍÖ") + "."
        return r.choice([f"{g} {f}"] * 5 + [f"{f}, {g}", f"{f}, {g}", f"{i()} {f}", f"{i()} {f}", f"{i()} {i()} {f}", f"{g} {i()} {f}", f"{g} {i()} {f}", f"{g} {r.choice(['von', 'van', 'van der', 'de', 'del', 'di', 'von der', 'de la', 'la', 'le'])} {f}", f"{g} {r.choice(['von', 'van', 'van der', 'de', 'del', 'di', 'von der', 'de la'])} {f}", f"{f}, {i()}"])

    def town(self) -> str:
        r = self.r
        t = self.proper()
        return r.choice([t] * 5 + [f"Saint-{t}", f"{t}-{self.proper()}", f"New {t}", f"Bad {t}"])

    def email(self, lang: str) -> str:
        r = self.r
        g, f = (self.proper().lower() if r.random() < 0.6 else r.choice(GIVEN["en"]).lower() for _ in range(2))
        plain = lambda x: x.encode("ascii", "ignore").decode() or "x"
        g, f = plain(g), plain(f)
        u = r.choice([f"{g}.{f}", f"{g}{self.digits(2)}", f"{g}_{f}", f"{g}-{f}", f"{g[0]}{f}", f"{f}.{g}+{self.word()}", f"{g}+{self.word()}{self.digits(1)}", "info", f"{f}{self.digits(4)}"])
        d = r.choice(["gmail.com", "yahoo.com", "outlook.com", f"{self.word()}.com", f"{self.word()}-{self.word()}.org", f"mail.{self.word()}.net", f"{self.word()}.ac.uk", f"{self.word()}.{self.word()}.edu", f"{self.word()}.de", f"{self.word()}.fr", f"{self.word()}.example", f"{self.word()}.io", f"{self.word()}.test", f"{self.word()}-{self.word()}.invalid"])
        e = f"{u}@{d}"
        k = r.random()
        if k < 0.3:
            at = r.choice([" [at] ", " (at) ", "(at)", "[at]", " at ", "{at}", " @ "])
            dot = r.choice([" [dot] ", " (dot) ", ".", ".", " dot " if at == " at " else "."])
            e = e.replace("@", at).replace(".", dot) if dot != "." and r.random() < 0.5 else f"{u}{at}{d.replace('.', dot)}"
        return e.upper() if r.random() < 0.12 else e

    _PHONES = ["+1 ### ### ####", "+1-###-###-####", "(###) ###-####", "###-###-####", "###.###.####", "1 (###) ###-####", "+44 #### ######", "+44 20 #### ####", "0#### ######", "(0####) ######", "(0####) ### ###", "0#### ###### ", "+49 (0)## #####-###", "+49 ### #######", "0##/########", "0## ##### ###", "0## ########", "+33 # ## ## ## ##", "0# ## ## ## ##", "0#.##.##.##.##", "+34 ### ### ###", "+34 ## ### ## ##", "+61 # #### ####", "+7 ### ###-##-##", "8 (###) ###-##-##", "+86 1## #### ####", "1##########", "0##-####-####", "+81 ##-####-####", "+91 ##### #####", "+30 21# #######", "+66 # #### ####", "+966 5# ### ####", "+1##########", "+44##########", "+49##########"]

    def phone(self, lang: str) -> str:
        return self.shaped(self.r.choice(self._PHONES).strip())

    _IDS = ["###-##-####", "###-##-####", "AA ## ## ## A", "AA######A", "AA#######", "A########", "A#######A", "########A", "## ### ### ###", "# ## ## ## ### ### ##", "###########", "AA##### ##", "AA#######", "AA ####### ", "########A", "# ## ## ## ### ### ##", "AA######A", "#### ####", "#### ###### ##", "AAA######", "AA ######", "######-####"]

    def id_number(self, lang: str) -> str:
        r = self.r
        if lang == "zh" and r.random() < 0.5:
            return self.digits(17) + r.choice("0123456789X")
        if lang in ("hi", "ja") and r.random() < 0.5:
            return self.shaped("#### #### ####")
        return self.shaped(r.choice(self._IDS).strip())

    def address(self, lang: str) -> str:
        r, t = self.r, self.town()
        n = str(r.randint(1, 300)) + r.choice(["", "", "", "a", "b", "B"])
        if lang == "de":
            s = r.choice([self.proper() + r.choice(_STREETS["de"]), f"{r.choice(['Am', 'An der', 'Im', 'Zum', 'Unter den'])} {self.word(True)} {self.word(True)}"[: 40], self.proper() + "er " + r.choice(["Straße", "Weg", "Allee", "Platz"]), self.proper() + r.choice(["str.", "straße"])])
            return f"{s} {n}, {self.digits(5)} {t}" if r.random() < 0.9 else f"{s} {n}\n{self.digits(5)} {t}"
        if lang == "fr":
            return f"{r.randint(1, 300)}{r.choice(['', '', ' bis', ' ter', 'B'])}{r.choice([', ', ', ', ' '])}{r.choice(_STREETS['fr'])} {r.choice(['de la', 'du', 'des', 'de', 'Saint', 'de l’'])} {self.word(True)}{r.choice(['', '', '-' + self.word(True)])}, {self.digits(5)} {t}"
        if lang == "es":
            return f"{r.choice(_STREETS['es'])} {r.choice(['de la', 'del', 'de los', 'de', 'Gran', 'San'])} {self.word(True)}{r.choice(['', '', ' ' + self.word(True)])}{r.choice([', ', ', ', ' '])}{r.randint(1, 300)}{r.choice(['', '', ', 2.º B', ', 4º A', ', 1.º C', ', bajo'])}, {self.digits(5)} {t}"
        if lang == "ru" and r.random() < 0.8:
            return f"{r.choice(['ул.', 'пр.', 'пер.', 'улица'])} {r.choice(['Ленина', 'Садовая', 'Пушкина', 'Мира', 'Новая', 'Лесная'])}{r.choice([',', ''])} {r.choice(['', 'д. '])}{r.randint(1, 90)}{r.choice(['', ', кв. ' + self.digits(2)])}, {r.choice(['Москва', 'Казань', 'Томск', 'Омск', 'Самара', 'Тверь'])}"
        if lang == "el" and r.random() < 0.8:
            return f"{r.choice(['Οδός ', ''])}{r.choice(['Ερμού', 'Αθηνάς', 'Σόλωνος', 'Πανεπιστημίου'])} {r.randint(1, 90)}, {self.shaped('### ##')} {r.choice(['Αθήνα', 'Πάτρα', 'Βόλος'])}"
        if lang == "zh" and r.random() < 0.8:
            return f"{r.choice(['北京', '上海', '广州', '南京', '武汉'])}市{r.choice(['朝阳', '海淀', '浦东', '天河', '鼓楼'])}区{r.choice(['中山', '人民', '建设', '解放', '长江'])}路{r.randint(1, 300)}号"
        if lang == "ja" and r.random() < 0.8:
            return f"{r.choice(['東京都', '大阪府', '京都府'])}{r.choice(['港区', '北区', '中央区', '南区'])}{r.choice(['本町', '栄町', '緑町', '東山'])}{r.randint(1, 9)}-{r.randint(1, 20)}-{r.randint(1, 30)}"
        if lang == "ar" and r.random() < 0.8:
            return f"{r.randint(1, 90)} شارع {r.choice(['النصر', 'الملك فهد', 'الجامعة', 'السلام'])}، {r.choice(['القاهرة', 'الرياض', 'دمشق', 'عمان'])}"
        if lang == "hi" and r.random() < 0.8:
            return f"{r.randint(1, 90)}, {r.choice(['गांधी मार्ग', 'नेहरू रोड', 'स्टेशन रोड'])}, {r.choice(['दिल्ली', 'मुंबई', 'जयपुर', 'पुणे'])} {self.digits(6)}"
        if lang == "th" and r.random() < 0.8:
            return f"{r.randint(1, 90)} ถนน{r.choice(['สุขุมวิท', 'พระราม', 'สีลม', 'เพชรบุรี'])} {r.choice(['กรุงเทพ', 'เชียงใหม่', 'ขอนแก่น'])} {self.digits(5)}"
        s = f"{r.choice([self.proper(), self.word(True), self.word(True) + self.word(), self.word(True) + ' ' + self.word(True)])} {r.choice(_STREETS['en'])}"
        post = r.choice([self.shaped("AA# #AA"), self.shaped("A## #AA"), self.shaped("AA## #AA"), self.shaped("AA #####"), self.digits(5)])
        flat = r.choice(["Flat", "Apt", "Apt.", "Unit", "Suite", "Apartment"]) + f" {r.randint(1, 60)}{r.choice(['', '', 'B'])}"
        gap = r.choice([", ", ", ", "\n"])
        return r.choice([f"{n} {s}{gap}{t} {post}", f"{n} {s}{gap}{t} {post}", f"{n} {s}, {t}, {post}", f"{flat}, {n} {s}{gap}{t} {post}", f"{flat}, {n} {s}{gap}{t}", f"{n} {s}, {flat}{gap}{t} {post}", f"{n} {s}, {flat}, {t}", f"{n} {s}{gap}{t}", f"{n} {s}, {t}"])

    def filler(self, k: str, lang: str) -> str:
        r = self.r
        simple = {
            "s": lambda: self.family("en") + ("-" + self.family("en") if r.random() < 0.08 else ""), "w": self.word, "W": lambda: self.word(True), "T": self.town, "d": lambda: str(r.randint(1, 99)), "y": lambda: str(r.randint(1950, 2030)),
            "n": lambda: r.choice([f"{r.randint(0, 9999)}.{self.digits(r.randint(1, 3))}", f"{r.randint(0, 9999)},{self.digits(r.randint(1, 3))}", str(r.randint(1, 9999)), f"{r.randint(1, 99)},{self.digits(3)}"]),
            "c": lambda: self.shaped(r.choice(["AA-#####", "AA-#####", "A#", "AA###", "A-###", "aaa##"])), "u": lambda: r.choice("W J K N A V C F H T Hz kN Pa kPa MPa mm nm µm μm ms mV kg dB Å Ω km °C %".split()),
            "r": lambda: r.choice([self.digits(3), self.digits(4), self.digits(5), self.digits(6), self.digits(7), self.shaped("####-####-###"), self.shaped("AA#######"), self.shaped("#-##-######"), self.shaped("######-#######"), self.shaped("###-#-##-######-#"), self.shaped("##########-#"), self.shaped("###-####"), self.shaped("####/##"), self.shaped("###-##-##A"), self.shaped("AA-#####"), self.shaped("#######"), self.shaped("########-####"), self.shaped("########T######")]),
            "R": lambda: r.choice(ROLES[lang]), "P": lambda: r.choice(PAPERS[lang]),
            "q": lambda: r.choice(self.v[lang]), "Q": lambda: r.choice([r.choice(self.v[lang]).capitalize(), self.proper(), r.choice(FAMILY[lang]) if lang in FAMILY else self.proper()]),
        }
        return simple[k]()


def labelled_sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts of one to four sentences with (start, end, kind) of what is to be found."""
    r = random.Random(seed)
    m = Maker(r)
    langs = ["en"] * 12 + ["de"] * 4 + ["fr"] * 3 + ["es"] * 3 + ["ru", "ru", "el", "zh", "zh", "zh", "ja", "ja", "ja", "ar", "ar", "hi", "hi", "th", "th"]
    out = []
    for _ in range(n):
        lang = r.choice(langs)
        text, spans = "", []
        for k in range(r.choice([1, 2, 3, 4])):
            if k:
                text += r.choice(["", "\n"] if lang in ("zh", "ja") else [" ", " ", " ", " ", "\n", "\n\n"])
                if r.random() < 0.12:
                    lang = r.choice(langs)
            what = r.random()
            if what < (0.45 if lang not in ("zh", "ja", "ar", "hi", "th") else 0.75):
                text += m.prose(lang, find=r.choice(["name", "name", "email", "phone", "address"]) if what < 0.1 else None, spans=spans, at=len(text))
                continue
            k = r.random()
            pattern = r.choice(PATTERNS[lang] if k < 0.35 else _PEOPLE if k < 0.45 and lang in ROLES else AROUND.get(lang, PATTERNS[lang]) if k < 0.62 else PLAIN[lang])
            for part in re.split(r"(<\w+>|\{\w\})", pattern):
                if part[:1] == "<" and part[1:-1] in ("name", "email", "phone", "id_number", "address"):
                    of = lang if r.random() < 0.8 else r.choice(["en", "de", "fr", "es"])
                    s = getattr(m, part[1:-1])(of)
                    spans.append((len(text), len(text) + len(s), part[1:-1]))
                    text += s
                else:
                    text += m.filler(part[1], lang) if part[:1] == "{" and len(part) == 3 and part[1].isalpha() else part
            if r.random() < 0.04 and text[-1:] in ".!?":
                text = text[:-1]
        out.append((text, [s for s in spans if s[1] <= len(text)]))
    return out
