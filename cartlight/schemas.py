"""Declared types of the tables; readers never infer JSON schemas."""

from __future__ import annotations

VOUCHER = (
    "struct<voucher_type:string,threshold:double,discount_type:string,face_value:double,"
    "discount:double,cap:double,price_after_voucher:double,budget:double>"
)
CONSTRAINT = (
    "struct<product_id:string,title:array<string>,sku_options:array<map<string,string>>,"
    "attributes:array<map<string,array<string>>>,service:array<string>,"
    "price:array<struct<mode:string,lo:double,hi:double>>>"
)
PRODUCT = (
    "struct<product_id:string,shop_id:string,brand:string,category:string,title:string,"
    "short_description:string,description:string,specification:string,price:double,sold_count:bigint,"
    "sku_options:map<string,map<string,string>>,attributes:map<string,array<string>>,service:array<string>,"
    "main_image_url:string,product_url:string>"
)
DOCUMENT = f"id string, contents string, product {PRODUCT}"
QUERY = f"query string, reward array<{CONSTRAINT}>, voucher {VOUCHER}"
CALL = "struct<name:string,parameters:map<string,string>,tool_call_id:string>"
OBSERVATION = "struct<tool_call_id:string,results:string>"
MESSAGE = f"struct<think:string,tool_call:array<{CALL}>,obs:array<{OBSERVATION}>,response:string>"
STEP = (
    "struct<prompt:array<struct<role:string,content:string>>,"
    f"completion:struct<reasoning_content:string,content:string,message:{MESSAGE}>,"
    "extra_info:struct<step:int,query:string,timestamp:bigint>>"
)
FEED = (
    "product_id string, shop_id string, brand_name string, category_hierarchy string, title string, "
    "short_description string, description string, specification string, price string, sold_cnt string, "
    "sku string, spu string, cpv string, main_image_url string, product_url string, service array<string>"
)
