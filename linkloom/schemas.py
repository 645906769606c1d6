"""Schemas of the library's tables."""

from __future__ import annotations

PAGE = "page_id long, url string, html string"
NODE = "page_id long, node_id int, parent_id int, pre int, last int, post int, depth int, tag string, attrs map<string,string>, own_text string, outer_hash long, text_from int, text_to int, table_pre int, row_pre int, n_a int, n_img int, n_table int, ref string"
#: The row that stands for a whole page: all its text, its url as an attribute.
PAGE_TAG = "#page"
PART_CODES = {"Text": 1, "Link": 2, "File": 3, "Table": 4, "Row": 5, "Article": 6, "AutoDetect": 7, "Stream": 8, "Form": 9, "Meta": 10}
URI_TYPES = {"Onetime": 1, "Periodic": 2, "Found": 3, "Custom": 4, "Collector": 5}
CONTINUATION = {"None": 1, "All": 2, "DomainOnly": 3, "TrackLinksOnly": 4, "Custom": 5, "Onetime": 6}
URI = "id string, uri string, base_uri string, routing_key string, uri_type int, cron string, is_completed boolean, is_skipped boolean, created timestamp, updated timestamp"
CRAWL_URI = "id string, uri_id string, scheduled_at timestamp, completed_at timestamp, created timestamp, updated timestamp"
CRAWL_URI_EVENT = "base_uri string, uri string, uri_type int"
CONFIG = "id string, host string, uri string, is_collector boolean, document string, collectable_pattern string, url_skip_list array<string>, continuation int, download_content boolean, provide_raw boolean, should_index boolean"
MESSAGE = "id string, payload_type string, payload string, routing_key string, correlation_id string, properties map<string,string>"
DEADLETTER = MESSAGE + ", stage string, target string, error string"
ROUTE = "kind string, match string, target string"
COMPONENT = "exchange string, kind string, name string, is_active boolean, registered_at timestamp"
