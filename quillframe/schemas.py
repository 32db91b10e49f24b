"""Explicit, nullable schemas of the layout tables."""

from __future__ import annotations

import re

RECT = "struct<left:double,top:double,width:double,height:double>"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
TYPE = "struct<family:string,size:double,weight:string,style:string,char_spacing:double>"

PAGE = "doc_id long, page_index int, width double, height double, scale double, ocr_languages array<string>"
RAW_ITEM = "doc_id long, page_index int, item_seq int, str string, font_name string, transform array<double>, width double, height double"
STYLE = "font_name string, font_family string, font_weight string, ascent double, descent double"
OCR_WORD = f"doc_id long, page_index int, word_seq int, text string, confidence double, bbox {BOX}"
TEXT_BOX = f"""doc_id long, page_index int, box_seq int, source string, original_text string, edited_text string,
has_edit boolean, is_deleted boolean, original {TYPE}, edit {TYPE}, base_rect {RECT}, cur_rect {RECT}, pad_x double, pad_y double,
ink_x double, ink_y double, scale_x double, ascent double, mask_color string, text_color string"""
EDIT_OP = f"""op_seq int, page_index int, source_width double, source_height double, original_text string,
base_rect {RECT}, current_rect {RECT}, pad_x double, pad_y double, ink_x double, ink_y double, text string,
font_family string, font_size double, font_weight string, font_style string, char_spacing double, font_scale_x double,
ascent double, text_color string, mask_color string, strict_fit boolean, micro_calibration boolean"""
SPAN = f"page_index int, span_seq int, rect {BOX}, font string, size double, color int, flags int, ascender double, descender double, origin struct<x:double,y:double>"
PAGE_FONT = "page_index int, font_seq int, xref int, basefont string, resource_name string"
PALETTE = "idx int, name string, hex string"
COLOUR = "node_seq long, attr string, raw string"
MASK = "mask_id long, width int, height int, bits array<tinyint>"
SPLIT_RANGE = "range_idx int, from_raw string, to_raw string"
HISTORY_EVENT = "page_key long, event_seq long, kind string, snapshot string"
I18N = "lang string, key string, template string"
#: request body of an exact export, camel case as sent
REQUEST_OP = """pageIndex int, sourceWidth double, sourceHeight double, baseRect struct<left:double,top:double,width:double,height:double>,
currentRect struct<left:double,top:double,width:double,height:double>, padX double, padY double, inkOffsetX double, inkOffsetY double,
text string, fontFamily string, fontSize double, fontWeight string, fontStyle string, charSpacing double, fontScaleX double, ascent double,
textColor string, maskFillColor string, strictFit boolean, microCalibration boolean"""
_FIELDS = [f.split(" ", 1) for f in re.split(r",\s*(?![^<]*>)", REQUEST_OP)]
REQUEST = "fileName string, pdfBase64 string, operations array<struct<" + ",".join(f"{n.strip()}:{t}" for n, t in _FIELDS) + ">>"
