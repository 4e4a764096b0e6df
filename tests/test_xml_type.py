"""Conversion of texts to XML: texts with known outcomes."""

import subprocess
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from servertide.functions.xml_type import _accepts, well_formed_xml

DEEP = "<p>" * 128 + "</p>" * 128
TAKEN = [
    "<a><b>1</b></a>", "<a/><b/>", "plain", "", "one <a/> two", " <a/>", "<a>&amp;&lt;&gt;&quot;&apos;&#65;&#x1F600;</a>", "<a><!-- x --></a>",
    "<a><![CDATA[<&]]></a>", "<?p x?><a/>", "<p:a xmlns:p='u'><p:b/></p:a>", "<a xml:lang='e'/>", "<a b='&lt;'/>", "<a b='>'/>", "<é>x😀</é>",
    "<?xml version='1.0'?><a/>", '<?xml version="1.0" encoding="utf-16" standalone="yes"?>\n<a/>', "<a xmlns='u'><b xmlns=''/></a>", DEEP, "<a/>" * 500,
    "<a p:b='1' q:b='1' xmlns:p='u' xmlns:q='v'/>",
]
REFUSED = [
    "<a><b>", "<a></b>", "<A></a>", "<a></a", "</fragment><fragment>", "<a b='1' b='2'/>", "<a b=1/>", "<a b='<'/>", "<a>&nbsp;</a>", "<a>&#1;</a>",
    "a & b", "a ]]> b", "a < b", "\x01", "<a>￾</a>", "<!DOCTYPE a><a/>", "<!DOCTYPE a [<!ENTITY x 'y'>]><a>&x;</a>", "<a><!-- x -- y --></a>", "<1a/>",
    "<p:a/>", "<a p:c='1'/>", "<a:b:c xmlns:a='u'/>", "<a xmlns:p=''/>", "<a xmlns:p='u' xmlns:q='u' p:c='1' q:c='2'/>",
    " <?xml version='1.0'?><a/>", "<a/><?xml version='1.0'?>", "<?xml version='1.1'?><a/>", '<?xml version="1.0" encoding="utf-8"?><a/>',
    f"<p>{DEEP}</p>", "<a>" * 100_000,
]


def test_known_texts(spark):
    texts = TAKEN + REFUSED + [None]
    table = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {r.n: r.xml for r in table.select("n", well_formed_xml(F.col("text")).alias("xml")).collect()}
    assert [got[n] for n in range(len(texts))] == TAKEN + [None] * (len(REFUSED) + 1)


def test_texts_of_one_byte_a_unit(spark):
    texts = ['<?xml version="1.0" encoding="utf-8"?><a/>', '<?xml version="1.0" encoding="UTF-16"?><a/>', "<a/>"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.xml for r in table.select(well_formed_xml(F.col("text"), wide=False).alias("xml")).collect()] == [texts[0], None, "<a/>"]


def test_large_texts(spark):
    body = "<row a='1'>text</row>" * 200_000
    table = spark.createDataFrame([(1, f"<p>{body}</p>"), (2, f"<p>{body}")], "n int, text string")
    assert {r.n: r.ok for r in table.select("n", well_formed_xml(F.col("text")).isNotNull().alias("ok")).collect()} == {1: True, 2: False}


def test_no_rows(spark):
    assert spark.createDataFrame([], "text string").select(well_formed_xml(F.col("text")).alias("xml")).collect() == []


def test_workers_need_no_code_of_the_package():
    work = cloudpickle.dumps(_accepts(True, 128))
    code = "import pickle, sys; f = pickle.loads(sys.stdin.buffer.read()); print(f('<a/>'), f('<a>'), f(None))"
    out = subprocess.run([sys.executable, "-c", code], input=work, capture_output=True, cwd="/", check=True)
    assert out.stdout.decode().split() == ["True", "False", "None"]
