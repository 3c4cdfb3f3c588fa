import re

from brandlens.plans import jobs
from brandlens.sources.lake import Lake


def test_report_lists_every_priority(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    entries = spark.createDataFrame([(k, f"https://site.org/p{k}", 0.5) for k in range(30)], "ord long, url string, priority double")
    page = "<html><body><p>Plain words on a page of no use.</p></body></html>"
    jobs.scrape(lake, "p", entries, "", lambda url: (200, page), cap=None)
    text = jobs.audit(lake, "p", "Alpha", ["Beta"], "tracking", lambda prompt: "Alpha is fine.", prompts=4, runs=1)
    rows = re.findall(r"^\| (?:SEO|GEO|AEO) \| .*$", text, re.M)
    assert len(rows) == lake.read("report", "finding").count() > 100
