"""Declared schemas of the tables the operators read.

Input is read with these schemas (``mode=PERMISSIVE``); null and the empty string
both mean "missing" and are normalised at the edge by the readers.
"""

from __future__ import annotations

VARIANT = (
    "struct<id bigint, title string, sku string, barcode string, weight double, weight_unit string, "
    "price string, inventory_quantity bigint, option1 string, option2 string, option3 string>"
).replace(" bigint", ":bigint").replace(" string", ":string").replace(" double", ":double")

PRODUCTS = (
    "id bigint, title string, handle string, vendor string, product_type string, tags string, "
    f"status string, options array<string>, variants array<{VARIANT}>, "
    "images array<struct<id:bigint,src:string,alt:string,position:int,width:int,height:int>>"
)

CATALOG_ENTRY = (
    "struct<name:string,url:string,images:array<string>,source:string,brand:string,category:string,"
    "handle:string,skus:array<string>,barcodes:array<string>,product_type:string,"
    "amazon_images:array<string>,img_feat:struct<b:string,v:array<double>>>"
)
CATALOG_LIST_FEED = (
    "id bigint, title string, handle string, vendor string, product_type string, image_url string, "
    "image_urls array<string>, tags array<string>"
)
FEED_PAGE = (
    "struct<products:array<struct<id:bigint,handle:string,title:string,vendor:string,product_type:string,"
    "body_html:string,images:array<struct<src:string>>,"
    "variants:array<struct<sku:string,barcode:string>>>>>"
)
BACKUP_METADATA = "map<string,struct<alt:string,filename:string,position:int>>"
URL_HISTORY = "array<struct<url:string,fecha:string,workflow:string,resultado:string>>"
MERGE_PLAN = (
    "`group` string, keep_id bigint, title string, keep_size string, keep_var_id bigint, "
    "absorb array<struct<product_id:bigint,variant_id:bigint,size:string,price:string,sku:string>>"
)
FEATURE = "struct<b:string,vec:array<float>,hash:array<bigint>>"
