from studyhall.functions.exprs import *  # noqa: F401,F403
from studyhall.functions.geo import bounding_box, haversine_km, valid_coordinates, within_km  # noqa: F401
from studyhall.functions.links import embed_url, file_id, is_valid_url, url_class, video_id  # noqa: F401
from studyhall.functions.tokens import access_code, qr_code, qr_parts  # noqa: F401
