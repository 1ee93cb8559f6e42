"""p4: the sentence units of hand-made texts; | stands where a further sentence starts."""

from datetime import datetime

from quillmesh.llm.sentence_starts import found

T = datetime(2026, 1, 1)
CASES = [
    "It is calm. |It is bright! |Is it?! |Yes.",
    "One line\nbreak stays.\n|Next one. \xa0|Third",
    "No stop here\n\n|but a blank line\r\n \r\n|and another",
    "See fig. 9.8, cf. p.\n21, acc. to Dr. E. Fox of St. Orlo. |Prof. Ray met Lin M. Poe.",
    "The passport no. L68 R47 is here. |No. |Seen from here it is fine, i.e. good, etc. |Next.",
    '"Why not?" was one reply. |"Well done!" |Good. |(13) what remains.',
    "Hmm… well, it is... |Every end ... or does it? |Mail a.Bo@mail.Example.com. |Then go.",
    "It intends.Although |weak.".replace("intends.Although |weak", "intends.|Although weak"),
    "Die Tiefe beträgt ca. 3,5 m, z. B. hier. |Am 4. Mai war es m. E. klar, vgl. Abb. 4. |„Gut!“, sagte er.",
    "L'ensemble (cf. p. 16) va; oui. |«\xa0C'est lourd\xa0!\xa0», dit-il. |Env. 7,6 m, p. ex. au nord.",
    "Mide aprox. 2,9 m, p. ej. en el muro (véase pág. 21). |¡Qué claro! |¿Sí?",
    "Γιατί είναι βαρύ; |Έχει ύψος 2,9 μ., π.χ. βόρεια. |«Πολύ βαρύ!», είπε.",
    "قالت اللجنة: «السقف ثقيل!» ثم صمتت. |لماذا الدرج ضيق؟ |انظر ص. 7.",
    "डॉ. साहब के अनुसार मंडप शांत है। |कितना सुंदर!  |क्यों है?",
    "庭院不够安静！|评审说：“走廊很压抑！”值得保留。|楼梯高约29.9米。",
    "「階段が豊かだ。」と審査員は述べた。|広間は静かだ｡|中庭",
    "ควรให้บันไดสว่าง |ระเบียงแบบ loft ดูสวยงาม |หลังคาสูง 19.1 เมตร",
    "The firm Go & B\ufeffros. is here, ap\u00adprox. 9 m. |\u200bAmeri\u200bca.\u200b |Then.",
    "",
    " \n ",
]


def test_units_of_every_script(spark):
    comments = [(f"c{i:02}", c.replace("|", ""), "form", T) for i, c in enumerate(CASES)]
    comments += [comments[0], ("scan", "A. B. It is. So", "scan", T), ("null", None, "mail", T)]
    c = spark.createDataFrame(comments, "comment_id string, text string, channel string, ingested_at timestamp")
    s = spark.createDataFrame([("s1", "😀 One. Two", T), ("s1", "😀 One. Two", T)], "sent_id string, sentence string, ingested_at timestamp")
    rows = [tuple(r) for r in found(c, s).collect()]
    assert len(rows) == len(set(rows))
    assert [r for r in rows if r[0] == "sentence"] == [("sentence", "s1", 7)]
    cut = {i: set() for i, *_ in comments}
    for kind, i, at in rows:
        if kind == "comment":
            cut[i].add(at)
    for i, text, *_ in comments[: len(CASES)]:
        assert "".join("|" * (k in cut[i]) + ch for k, ch in enumerate(text)) == CASES[int(i[1:])]
    assert not cut["scan"] and not cut["null"]
