"""Fixed record schemas. Readers never infer."""

WORKSHEETS = """id string, name string, title string, page_no int, rotation_angle int, blueprint_file_id string,
  blueprint_file_url string, scale double, num_metric string, den_metric string, is_workable boolean,
  image struct<width:int,height:int,image_url:string>"""

# coordinates differ by geometry type, so they stay JSON text until the type is known
GEOMETRIES = """outputs array<struct<feature:struct<id:string,name:string,geometry_type:int>,
  output_geojson:struct<features:array<struct<geometry:struct<type:string,coordinates:string>,
  properties:struct<tags_info:map<string,struct<tagId:string>>>>>>>>"""

POINT = "array<double>"
LINE = "array<array<double>>"
POLYGON = "array<array<array<double>>>"

TAG_LIBRARY = "tag_types array<struct<id:string,name:string,tags:array<struct<id:string,name:string>>>>"

MANIFEST = """path string, name string, slug string, wid string, rid string, box struct<x:int,y:int,w:int,h:int>,
  hull array<array<int>>, score double, source string, layer string, zoom double"""

CANDIDATES = """rid string, wid string, npz string, k int, label int, iou double, conf double, w int, h int, area int,
  cx int, cy int, ch int, cw int, split string"""

DRYRUN = """source_rid string, target_rid string, source_wid string, target_wid string, n_boxes int, n_points int,
  raster_wh array<int>, target_fe_wh array<int>, source_fe_wh array<int>,
  styles map<string,struct<layer_order:int>>, descriptions map<string,string>,
  layers array<struct<name:string,output_geojson:struct<features:array<struct<geometry:struct<type:string,
  coordinates:string>>>>>>, _corrupt_record string"""

EMBEDDINGS = "id bigint, vec array<float>, label int, path string"

CATEGORY_MAP = "layer_name_regex string, category_name string, category_id int"

TABLES = "index int, bbox array<int>, rows array<array<struct<bbox:array<int>,value:string>>>"

HITS = """rid string, wid string, tile_y bigint, tile_x bigint, mask_id bigint, x bigint, y bigint, w bigint, h bigint,
  score double, conf double"""
