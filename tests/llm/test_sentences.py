import time

import pytest

from tidemill.llm.sentences import sentence_spans, sentence_units

CASES = [
    ["Dr. Smith said it uses approx. 3.5 GB, i.e. a lot.", "Mr. and Mrs. Roe left on Jan. 4 with soup."],
    ["It stopped at 5 p.m. on Monday and came back at 6 a.m.", "They sell jam, gear, etc.", "The U.S. region is fine."],
    ['He wrote: "We will wait. Then we rest." and logged off.', '"Is it down?" asked the lead at 8:53.', "Next one."],
    ["(See the runbook, no. 9, for how to rest.)", "A note says (really?) nothing."],
    ["The office of Oak & Co. Inc. moved to St. Mary Square in May.", "The new address is 12 Oak St.", "We agreed."],
    ["Dr. Lang bat am 3. Mai darum, es zu prüfen, z. B. mit v1.2.3.", "„Läuft es noch?“, fragte das Lager.", "Es dauerte ca. 2 Stunden, d. h. lange."],
    ["« Faut-il archiver ? » a demandé l’équipe.", "M. Petit a noté 3 erreurs, p. ex. un port.", "Ne touchez pas !"],
    ["¿Puede el equipo hacerlo?", "¡No toquen nada!", "La Sra. Gil y EE. UU. aparecen en la pág. 6.", "«¿Hay que ir?», preguntó."],
    ["По плану склад ждёт 5 мин., т. е. до 7:00.", "Не хватает страниц и т. п.", "«Пора!» — написала команда.", "В г. Орёл хорошо."],
    ["डॉ. राम ने 5.5 घंटे लिखे।", '"क्या यह चालू है?" दल ने पूछा।', "अभी मत छुओ!"],
    ["قال د. سمير إن الفريق ينتظر.", "«هل يعمل؟» سأل الفريق.", "نعم!"],
]


@pytest.mark.parametrize("want", CASES)
def test_running_text(want):
    for joint in (" ", "\n", "  ", "\r\n"):
        text = joint.join(want)
        assert [text[s:e] for s, e in sentence_spans(text)] == want


def units(text):
    return [text[s:e] for s, e in sentence_spans(text)]


def test_scripts_without_blanks():
    want = ["平台组写道：“先重启网关。再通知我们。”然后下线了。", "还差9页，预算是$5……", "能归档吗？", "“要不要归档？”数据组问。"]
    assert units("".join(want)) == want
    assert units("「確認しますか？」と班が聞いた。次です。") == ["「確認しますか？」と班が聞いた。", "次です。"]
    assert units("ทีมขอให้ตรวจ ไฟล์ a.md ใช้เวลา 9.8 ชั่วโมง เราพบแล้ว") == ["ทีมขอให้ตรวจ", "ไฟล์ a.md ใช้เวลา 9.8 ชั่วโมง", "เราพบแล้ว"]


def test_layout():
    text = "# Head. Line\n\nFirst one.Second\none. third one.\n- item. Two\n2. other\nText after.\n```\ncode. Here\n\nmore\n```\n\n \nEnd without stop"
    assert units(text) == [
        "# Head. Line", "First one.", "Second\none.", "third one.", "- item. Two", "2. other", "Text after.",
        "```\ncode. Here\n\nmore\n```", "End without stop",
    ]
    assert units("cf. fig.\n177. The next.") == ["cf. fig.\n177.", "The next."]


def test_unclosed_openers_and_empty_texts():
    assert units('He said "stop. Then left. (Or so.') == ['He said "stop.', "Then left.", "(Or so."]
    for blank in (None, "", " \n\t", " "):
        assert sentence_spans(blank) == []
    assert len(sentence_spans("One. " * 20_000)) == 20_000


def test_rows(spark):
    df = spark.createDataFrame([(1, "Ab. Cd ef.", 0), (1, "Ab. Cd ef.", 0), (None, "x", 0), (3, None, 0)], "doc_id long, text string, start_pos int")
    rows = sorted((r.doc_id or 0, r.start_pos, r.end_pos) for r in sentence_units(df).collect())
    assert rows == [(0, 0, 1), (1, 0, 3), (1, 0, 3), (1, 4, 10), (1, 4, 10)]
    assert sentence_units(df.where("false")).count() == 0


def test_nested_lists():
    text = "- one\n  - two. Here\n    goes on\n  Of one. Still\n- three\nText. End."
    assert units(text) == ["- one", "- two. Here\n    goes on", "Of one. Still", "- three", "Text.", "End."]


@pytest.mark.parametrize(
    "text",
    ["- item\n" + "  goes on\n" * 100_000, "- item\n" + "goes on\n" * 125_000, "(" * 500_000 + ")" * 500_000, "([{" * 300_000 + "”" * 100_000,
     "x " + "(a.) b " * 140_000, "x\n1. y.\n" * 120_000, "Run on\n" * 140_000 + "1. x"],
)
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    sentence_spans(text)
    assert time.process_time() - began < 4
