"""The queries of this subpackage and the SQL of those that SQL can express."""

from tracewright.llm import exact, html_text, langid, media, mixing, pack, secrets, simhash, urls, warc

QUERIES = {
    "op1_pack": pack.op1_pack,
    "op2_mix": mixing.op2_mix,
    "op3_html": html_text.op3_html,
    "op4_simhash": simhash.op4_simhash,
    "op5_secrets": secrets.op5_secrets,
    "op6_exact": exact.op6_exact,
    "op7_urls": urls.op7_urls,
    "op8_warc": warc.op8_warc,
    "op9_media": media.op9_media,
    "op10_langid": langid.op10_langid,
}

ORACLES = {"op2_mix": mixing.ORACLE, "op6_exact": exact.ORACLE, "op7_urls": urls.ORACLE}
