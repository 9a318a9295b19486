"""Declared schemas of the catalog's tables."""

from __future__ import annotations

PORTS = "array<struct<entity:string,role:string,format:string,cardinality:string>>"
OFFERS = "array<struct<intent:string,method:string,amount:string,currency:string,description:string>>"
RAILS = "array<struct<protocol:string,version:string,networks:array<string>>>"
FACETS = "struct<domain:string,action:string,primary_entity:string,output_entity:string,modality:array<string>,authored:boolean>"
PAYMENT = f"struct<price_usd:double,paid:boolean,currency:string,rails:{RAILS},offers:{OFFERS}>"

ENDPOINT = (
    "id string, origin string, method string, path string, operation_id string, summary string, description string, tags array<string>, "
    "provider_fqn string, provider_title string, category string, capabilities array<string>, inputs array<string>, "
    f"facets {FACETS}, payment {PAYMENT}, service struct<categories:array<string>,docs:map<string,string>>, "
    "responses struct<has200:boolean,has402:boolean>, schema_missing boolean, guidance_available boolean, openapi_url string, "
    "search_text string, keyphrases array<string>, host_breadth int, built_at string, ep_ord long"
)
INTENT = (
    f"id string, label string, description string, aliases array<string>, schema_org array<string>, consumes {PORTS}, produces {PORTS}, "
    "facets struct<domain:string,action:string,modality:array<string>,freshness:string>, negative_terms array<string>, "
    "links array<struct<type:string,to:string,note:string>>, related array<string>, intent_ord int"
)
SATISFIES = "intent_id string, rank int, origin string, method string, path string, source string"
REGISTRY_RESOURCE = (
    "resource string, type string, accepts array<struct<amount:string,asset:string,network:string,payTo:string,scheme:string>>, "
    "description string, serviceName string, tags array<string>, method string, lastUpdated string"
)
SERVICE = (
    "id string, url string, serviceUrl string, description string, tags array<string>, endpoints array<struct<method:string,path:string,"
    "summary:string,description:string,payment:struct<amountHint:string,amount:string,decimals:int,currency:string>>>"
)
PROVIDER = "fqn string, title string, service_url string, endpoint_count int, min_price_usd double, max_price_usd double"
VECTOR = "text_hash string, model string, dim int, vec array<float>"
