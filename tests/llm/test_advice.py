"""Cases of the first review that earlier versions answered in part."""

import pytest

import corpus_pipeline
from tessera.llm import packing, pii, queries

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def test_packing_reads_added_tokens(spark, tmp_path):
    """op3_packing and the pipeline's last stage give the ids of ``tokenizers`` as it is loaded, added tokens included."""
    tokenizers = pytest.importorskip("tokenizers")
    coder = tokenizers.Tokenizer.from_file(VOCABULARY)
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}x", f"a  {end}  b\n", f"<|end{end}oftext|>", "plain  text ", "", f"é😀{end}" * 900]
    want = [coder.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert want[0] == [64, 220, 50256, 275, 1]
    encode = packing.ids_of(VOCABULARY, True)
    assert [[*encode(t), 1] for t in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["doc_tokens"] for r in queries.op3_packing(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == [len(x) for x in want]
    pieces = {}
    for r in corpus_pipeline.pack(spark, docs, str(tmp_path)).collect():
        pieces.setdefault(r["doc_id"], {})[r["start"]] = bytes(r["ids"])
    for i, x in enumerate(want):
        assert b"".join(v for _, v in sorted(pieces[i].items())) == b"".join(n.to_bytes(4, "little") for n in x)


#: One example account a country, as the registry prints them.
ACCOUNTS = """SA0380000000608010167519 AE070331234567890123456 BR1800360305000010009795493C1 IL620108000000099999999 QA58DOHB00001234567890ABCDEFG
    UA213223130000026007233566001 RS35260005601001611379 KZ86125KZT5004100100 AL47212110090000000235698741 AD1200012030200359100100 AZ21NABZ00000000137010001944
    BH67BMAG00001299123456 BY13NBRB3600900000002Z00AB00 BA391290079401028494 CR05015202001026284066 DO28BAGR00000001212453611324 EG380019000500000000263180002
    SV62CENR00000000000000700025 FO6264600001631634 GE29NB0000000101904917 GI75NWBK000000007099453 GL8964710001000206 GT82TRAJ01020000001210029690
    IQ98NBIQ850123456789012 JO94CBJO0010000000000131000302 XK051212012345678906 KW81CBKU0000000000001234560101 LB62099900000001001901229114
    LC55HEMM000100010012001200023015 MR1300020001010000123456753 MU17BOMM0101101030300200000MUR MD24AG000225100013104168 ME25505000012345678951
    MK07250120000058984 PK36SCBL0000001123456702 PS92PALS000000000400123456702 SC18SSCB11010000000000001497USD ST23000100010051845310146 TL380080012345678910157
    TN5910006035183598478831 VA59001123000012345678 VG96VPVG0000012345678901 LY83002048000020100120361 SD2129010501234001 BI4210000100010000332045181
    DJ2100010000000154000100186 RU0304452522540817810538091310419 SO211000001001000100141 NI45BAPR00000013000003558124 MN121234123456789123 FK88SC123456789012
    OM810180000001299123456 YE15CBYE0001018861234567891234 HN88CABF00000000000250005469 DE89370400440532013000 FR1420041010050500013M02606 NO9386011117947""".split()


def test_every_account_is_found():
    """op7_pii: lists of accounts, rejected starts before an account, and all countries of the registry."""
    spaced = lambda a: " ".join(a[i : i + 4] for i in range(0, len(a), 4))
    of = lambda t: [t[s:e] for s, e, k, _ in pii.find_spans(t) if k == "iban"]
    for form in (str, spaced):
        assert of(" ".join(map(form, ACCOUNTS))) == [form(a) for a in ACCOUNTS]
    de, fr = spaced("DE89370400440532013000"), spaced("FR1420041010050500013M02606")
    assert of(f"{de} {fr}") == [de, fr]
    for head in ("AB12", "DE88", "XX00 YY11", "GB82 WEST", "DE89 3704"):
        assert of(f"{head} {de}") == [de], head
    assert of(f"{de}7 x{de} {de[:-1]}1") == []
    assert pii.redact(f"{de} {fr}, {fr}", pii.find_spans(f"{de} {fr}, {fr}")) == "[iban] [iban], [iban]"
