"""pagescout: finding product pages in crawled web data with Spark.

Sub-packages:

* ``functions``  - Column expressions over URLs, HTML and XML text
* ``operators``  - DataFrame -> DataFrame operators (signals, links, robots, sitemaps, frontier, reports)
* ``sources``    - readers for the input tables and the JSON sink
* ``plans``      - multi-stage jobs: page facts and the bounded crawl closure
* ``streaming``  - the same scoring and counting over unbounded page feeds
"""
