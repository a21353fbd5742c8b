"""Sample drawings with known contents: an encoder of its own and what a reader must find.

Nothing here uses the layouts or the reader of the library. A sample states a
record's values in wire order, written down from the format's description:
`CODE:value>place`, where the place names the value in the decoded record;
`=value>place` is a value that follows from others, `@2007` and `@<2007` keep an
item to versions, `!` keeps a number as it is. A file's content depends on its
version and on a small number k, which is added to the other real numbers.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from functools import lru_cache

from draftlake.sources import container as C

VERSIONS = {"AC1018": 2004, "AC1024": 2010, "AC1027": 2013, "AC1032": 2018}
#: How many kinds of content there are, and the length of a path (modulo 17) whose file is cut short.
CONTENTS, BROKEN = 3, 12

_TEH = "TV:Name-1>header.name B:0>header.is_xref_dependent BS:3>header.xref_index_plus_1 B:1>header.is_xref_resolved "
_PRE = "BS:0 B:0 BB:2 BL:0 B:1 B:0@2004 B:1 B:1 BS:7 !BD:1 BB:0 BB:0 BB:0@2007 BB:0@2007 B:0@2010 B:0@2010 B:0@2010 BS:0 RC:29 "
_FULLTEXT = (
    "RC:255 RD:2.5>elevation 2RD:5,6>insertion_point 2RD:8,9>alignment_point BE:0,1,0>extrusion BT:1.5>thickness BD:.25>oblique_angle BD:.5>rotation_angle BD:3>height BD:.75>width_factor TV:Größe>text BS:2>generation BS:1>h_align BS:3>v_align"
)
_PLAINTEXT = "RC:0 =0.0>{0}elevation 2RD:5,6>{0}insertion_point BE:0,0,1>{0}extrusion BT:0>{0}thickness =0.0>{0}oblique_angle =0.0>{0}rotation_angle BD:2.5>{0}height =1.0>{0}width_factor TV:note>{0}text =0>{0}generation =0>{0}h_align =0>{0}v_align "
_DIM = (
    "RC:3>common.version_flag@2010 3BD:0,0,1>common.extrusion 2RD:4,5>common.text_midpoint BD:.5>common.elevation RC:6>common.flags TV:<>>common.user_text BD:.25>common.text_rotation BD:.125>common.horiz_dir 3BD:1,1,1>common.ins_scale "
    "BD:.75>common.ins_rotation BS:5>common.attachment BS:1>common.line_spacing_style BD:1.5>common.line_spacing_factor BD:42>common.actual_measurement B:0@2007 B:1>common.flip_arrow_1@2007 B:0>common.flip_arrow_2@2007 2RD:7,8>common.def_point_12 "
)
_SAT = "B:0>sat.empty BS:1>sat.version CHUNKS:body>sat.bytes "

# Kind, type code (a name of a class where it has none of its own, - for a record that is no object), wire.
ENTITIES = f"""
TEXT 01 {_FULLTEXT}
TEXT 01 {_PLAINTEXT.format("")}
ATTRIB 02 {_PLAINTEXT.format("text.")} TV:TAG>tag BS:4>field_length RC:8>flags B:1>lock_position@2018
ATTDEF 03 {_PLAINTEXT.format("text.")} TV:Ask>prompt TV:TAG>tag BS:4>field_length RC:8>flags B:1>lock_position@2018
BLOCK 04 TV:*D12>name
ENDBLK 05 =true>present
INSERT 07 3BD:1,2,3>insertion_point BB:0 !BD:2 !BD:3 !BD:4 =[2.0,3.0,4.0]>scale BD:.5>rotation BE:0,0,1>extrusion B:1>has_attribs
INSERT 07 3BD:1,2,3>insertion_point BB:1 !BD:2 =[2.0,2.0,2.0]>scale BD:.5>rotation BE:1,0,0>extrusion B:0>has_attribs
INSERT 07 3BD:1,2,3>insertion_point BB:3 =[1.0,1.0,1.0]>scale BD:.5>rotation BE:0,0,1>extrusion B:0>has_attribs
VERTEX_2D 0A RC:2>flag 3BD:1,2,0>location BD:.5>start_width BD:.25>end_width BD:-.5>bulge BL:77>vertex_id@2010 BD:1.25>tangent_direction
POLYLINE_2D 0F BS:1>flag BS:5>curve_type BD:.5>default_start_width BD:.25>default_end_width BT:0>thickness BD:3>elevation BE:0,0,1>extrusion
ARC 11 3BD:1,2,0>center BD:2.5>radius BT:.5>thickness BE:0,0,1>extrusion BD:0>start_angle BD:1.5>end_angle
CIRCLE 12 3BD:1.5,2,0>center BD:4.25>radius BT:0>thickness BE:0,0,-1>extrusion
LINE 13 B:0>is_2d !RD:1 !BD:3 !RD:2 !BD:4 !RD:5 !BD:0 =[1.0,2.0,5.0]>start =[4.0,6.0,5.0]>end BT:2>thickness BE:0,0,1>extrusion
LINE 13 B:1>is_2d !RD:1 !BD:3 !RD:2 !BD:4 =[1.0,2.0,0.0]>start =[4.0,6.0,0.0]>end BT:0>thickness BE:0,1,0>extrusion
DIMENSION_ORDINATE 14 {_DIM} 3BD:1,2,3>def_point_10 3BD:4,5,6>feature_location_13 3BD:7,8,9>leader_endpoint_14 RC:1>flag_2
DIMENSION_LINEAR 15 {_DIM} 3BD:1,2,3>def_point_13 3BD:4,5,6>def_point_14 3BD:7,8,9>def_point_10 BD:.5>extension_line_rotation BD:.25>dim_rotation
DIMENSION_ALIGNED 16 {_DIM} 3BD:1,2,3>def_point_13 3BD:4,5,6>def_point_14 3BD:7,8,9>def_point_10 BD:.5>extension_line_rotation
DIMENSION_ANG3PT 17 {_DIM} 3BD:1,2,3>def_point_10 3BD:4,5,6>def_point_13 3BD:7,8,9>def_point_14 3BD:10,11,12>def_point_15
DIMENSION_ANG2LN 18 {_DIM} 3BD:1,2,3>def_point_13 3BD:4,5,6>def_point_14 3BD:7,8,9>def_point_15 3BD:10,11,12>def_point_10 2RD:13,14>def_point_16
DIMENSION_RADIUS 19 {_DIM} 3BD:1,2,3>def_point_10 3BD:4,5,6>def_point_15 BD:.5>leader_length
DIMENSION_DIAMETER 1A {_DIM} 3BD:1,2,3>def_point_15 3BD:4,5,6>def_point_10 BD:.5>leader_length
POINT 1B 3BD:1,2,3>position BT:0>thickness BE:0,0,1>extrusion BD:.5>x_axis_angle
3DFACE 1C B:0 B:1 !RD:1 !RD:2 !BD:1 !BD:0 !BD:0 !BD:1 !BD:-1 !BD:0 BS:5 =[[1.0,2.0,0.0],[2.0,2.0,0.0],[2.0,3.0,0.0],[1.0,3.0,0.0]]>corners =5>invisible_edges =false>is_triangle
3DFACE 1C B:1 B:0 !RD:1 !RD:2 !RD:3 !BD:1 !BD:0 !BD:2 !BD:0 !BD:1 !BD:0 =[[1.0,2.0,3.0],[2.0,2.0,5.0],[2.0,3.0,5.0],[2.0,3.0,5.0]]>corners =0>invisible_edges =true>is_triangle
POLYFACE_MESH 1D BS:1>flags BS:8>vertex_count BS:6>face_count BS:2>m_density BS:3>n_density H:4/20>first_vertex_handle H:4/301>last_vertex_handle
POLYGON_MESH 1E BS:1>flags BS:2>m_density BS:3>n_density BS:8>m_vert_count BS:6>n_vert_count H:4/20>first_vertex_handle H:4/301>last_vertex_handle
SOLID 1F BT:0>thickness BD:2>elevation 2RD:0,0>corners.0 2RD:1,0>corners.1 2RD:0,1>corners.2 2RD:1,1>corners.3 BE:0,0,1>extrusion
TRACE 20 BT:3>thickness BD:2>elevation 2RD:0,0>corners.0 2RD:1,0>corners.1 2RD:0,1>corners.2 2RD:1,1>corners.3 BE:0,1,0>extrusion
VIEWPORT 22 3BD:1,2,3>center BD:10>width BD:20>height
ELLIPSE 23 3BD:1,2,3>center 3BD:4,0,0>major_axis 3BD:0,0,1>extrusion BD:.5>axis_ratio BD:0>start_param BD:6.25>end_param
SPLINE 24 BL:2>scenario BL:1>flag1@2013 BL:15>knot_param@2013 BD:3>degree BD:.5>fit.tolerance 3BD:1,0,0>fit.start_tangent 3BD:0,1,0>fit.end_tangent BL:2 3BD:1,2,3>fit.points.0 3BD:4,5,6>fit.points.1
SPLINE 24 BL:1>scenario BL:1>flag1@2013 BL:15>knot_param@2013 BD:1>degree B:1>control.rational B:0>control.closed B:0>control.periodic BD:.5>control.knot_tolerance BD:.25>control.control_tolerance BL:4 BD:0>control.knots.0 BD:0>control.knots.1 BD:1>control.knots.2 BD:1>control.knots.3 BL:2 3BD:1,2,3>control.points.0 3BD:4,5,6>control.points.1 BD:1>control.weights.0 BD:2>control.weights.1
REGION 25 B:0>acis_empty BS:1>version CHUNKS:solid>sat_blob
3DSOLID 26 B:0>acis_empty BS:1>version CHUNKS:solid>sat_blob
BODY 27 B:1>acis_empty
RAY 28 3BD:1,2,3>start 3BD:0,1,0>direction
XLINE 29 3BD:1,2,3>point 3BD:0,1,0>direction
MTEXT 2C 3BD:1,2,3>insertion_point 3BD:0,0,1>extrusion 3BD:1,0,0>x_axis_direction BD:40>rect_width BD:20>rect_height@2007 BD:2.5>nominal_text_height BS:1>attachment_point BS:5>drawing_direction BD:3>extents_height BD:12>extents_width TV:one\\Ptwo>text BS:1>linespace_style BD:1>linespace_factor B:0
LEADER 2D B:0 BS:1>annot_type BS:0>path_type BL:2 3BD:1,2,3>points.0 3BD:4,5,6>points.1 3BD:7,8,9>end_projection 3BD:0,0,1>extrusion 3BD:1,0,0>horiz_direction 3BD:2,2,2>offset_to_block_insertion
TOLERANCE 2E BS:3>unknown_short@2007 BD:2>height BD:.5>dimgap 3BD:1,2,3>insertion_point 3BD:1,0,0>x_axis_direction 3BD:0,0,1>extrusion TV:{{j}}>text_string H:5/33>dimstyle_handle
MLINE 2F BD:2>scale_factor RC:1>justification 3BD:1,2,3>scale_point 3BD:0,0,1>extrusion BS:1>open_closed_flags BS:2>num_lines BS:1 3BD:1,2,3>vertices.0.location 3BD:1,0,0>vertices.0.direction 3BD:0,1,0>vertices.0.miter BS:2 BD:0>vertices.0.lines.0.segments.0 BD:5>vertices.0.lines.0.segments.1 BS:0 =[]>vertices.0.lines.0.fills BS:1 BD:7>vertices.0.lines.1.segments.0 BS:1 BD:.5>vertices.0.lines.1.fills.0
OLE2FRAME 4A BS:2>ole_version DATA:olebytes>data BS:1>oleobject_type RC:0>mode
LWPOLYLINE 4D BS:1447>flag BD:2>elevation BD:.5>thickness 3BD:0,0,1>extrusion BL:2 BL:2 BL:1 BD:.25>constant_width 2RD:0,0>vertices.0 2RD:3,4>vertices.1 BD:.5>bulges.0 BD:0>bulges.1 =[]>vertex_ids BD:1>widths.0.start BD:2>widths.0.end =false>closed
LWPOLYLINE 4D BS:8>flag BL:3 2RD:0,0>vertices.0 2RD:3,4>vertices.1 2RD:3,0>vertices.2 =[]>bulges =[]>vertex_ids =[]>widths =true>closed
HATCH 4E BS:1 BL:0>gradient.reserved BD:.5>gradient.angle BD:.25>gradient.shift BL:1>gradient.single_color BD:.75>gradient.tint BL:1 BD:0>gradient.colors.0.value BS:3>gradient.colors.0.index TV:LINEAR>gradient.name BD:1>elevation 3BD:0,0,1>extrusion TV:SOLID>pattern_name B:1>solid_fill B:0>associative BL:1 BL:2>paths.0.flags B:1>paths.0.has_bulges B:1>paths.0.closed BL:2 2BD:0,0>paths.0.vertices.0.point BD:.5>paths.0.vertices.0.bulge 2BD:4,0>paths.0.vertices.1.point BD:0>paths.0.vertices.1.bulge BL:1 H:4/19>paths.0.boundary_handles.0 BS:0>pattern_style BS:1>pixel_size BL:1 2BD:2,2>seed_points.0 H:5/9@2007
HATCH 4E BS:0 BD:1>elevation 3BD:0,0,1>extrusion TV:ANSI31>pattern_name B:0>solid_fill B:1>associative BL:1 BL:1>paths.0.flags BL:4 RC:1>paths.0.edges.0.kind 2BD:0,0>paths.0.edges.0.line_start 2BD:4,0>paths.0.edges.0.line_end =[]>paths.0.edges.0.knots =[]>paths.0.edges.0.controls =[]>paths.0.edges.0.weights RC:2>paths.0.edges.1.kind 2BD:1,1>paths.0.edges.1.center BD:2>paths.0.edges.1.radius BD:0>paths.0.edges.1.start_angle BD:3>paths.0.edges.1.end_angle B:1>paths.0.edges.1.ccw =[]>paths.0.edges.1.knots =[]>paths.0.edges.1.controls =[]>paths.0.edges.1.weights RC:3>paths.0.edges.2.kind 2BD:1,1>paths.0.edges.2.center 2BD:2,0>paths.0.edges.2.major BD:.5>paths.0.edges.2.ratio BD:0>paths.0.edges.2.start_angle BD:3>paths.0.edges.2.end_angle B:0>paths.0.edges.2.ccw =[]>paths.0.edges.2.knots =[]>paths.0.edges.2.controls =[]>paths.0.edges.2.weights RC:4>paths.0.edges.3.kind BL:1>paths.0.edges.3.degree B:1>paths.0.edges.3.rational B:0>paths.0.edges.3.periodic BL:2 BL:1 BD:0>paths.0.edges.3.knots.0 BD:1>paths.0.edges.3.knots.1 2BD:5,6>paths.0.edges.3.controls.0 BD:1>paths.0.edges.3.weights.0 BL:1 2BD:7,8>paths.0.edges.3.fits.0 BL:0 =[]>paths.0.boundary_handles BS:1>pattern_style BD:.5>pattern_angle BD:2>pattern_scale B:0>pattern_double BS:1 BD:.75>pattern_lines.0.angle 2BD:0,0>pattern_lines.0.base 2BD:1,1>pattern_lines.0.offset BS:2 BD:3>pattern_lines.0.dashes.0 BD:-1>pattern_lines.0.dashes.1 BS:1>pixel_size BL:0 =[]>seed_points H:5/9@2007
PROXY_ENTITY 1F2 BL:501>proxy_class_id DATA:proxybytes>raw_proxy_data BL:2 H:3/20>handles.0 H:4/4660>handles.1
CAMERA@2007 4F8 3BD:1,2,3>origin 3BD:0,1,0>direction BD:50>focal_length BD:.5>field_of_view H:5/77>view_handle
SUN@2007 4F9 BL:1>version B:1>status BS:7>sun_color_index BD:.5>intensity B:1>has_shadow BL:2459000>julian_day BL:43200>time_of_day B:0>daylight_savings B:1>shadow_type_map_flag B:0>shadow_softness_flag B:1>shadow_map_size_flag BS:256>shadow_softness_samples
LIGHT@2007 4FA BL:1>version TV:Lamp>name BL:3>light_type B:1>is_on BS:1>shadow_type B:0>has_shadow_softness 3BD:1,2,3>position 3BD:4,5,6>target BD:.5>intensity BS:2>color_index B:1>plot_glyph
LIGHT@2007 4FA BL:1>version TV:Sky>name BL:1>light_type B:1>is_on BS:1>shadow_type B:0>has_shadow_softness BD:.5>intensity BS:2>color_index B:1>plot_glyph
GEODATA@2010 4FB BL:2>version H:4/31>block_handle 3BD:1,2,3>origin 3BD:1,0,0>design_to_ref_x_axis 3BD:0,1,0>design_to_ref_y_axis 3BD:4,5,6>reference_point 3BD:0,1,0>reference_north_dir BD:1>design_to_ref_x_scale BD:2>design_to_ref_y_scale TV:EPSG>coordinate_system_def TV:a>geo_rss_tag TV:b>observation_from_tag TV:c>observation_to_tag TV:d>observation_coverage_tag
IMAGE IMAGE BL:0 3BD:1,2,3>insertion_point 3BD:1,0,0>u_vector 3BD:0,1,0>v_vector 2RD:640,480>image_size BS:7>display_flags B:1>clipping RC:50>brightness RC:60>contrast RC:5>fade B:1>clip_mode@2010 =false>clip_mode@<2010 BS:2>clip_type BL:3 2RD:0,0>clip_boundary.0 2RD:9,0>clip_boundary.1 2RD:9,9>clip_boundary.2
IMAGE RASTERIMAGE BL:0 3BD:1,2,3>insertion_point 3BD:1,0,0>u_vector 3BD:0,1,0>v_vector 2RD:640,480>image_size BS:7>display_flags B:0>clipping RC:50>brightness RC:60>contrast RC:5>fade B:0>clip_mode@2010 =false>clip_mode@<2010 BS:1>clip_type BL:4 2RD:0,0>clip_boundary.0 2RD:9,9>clip_boundary.1
UNDERLAY PDFUNDERLAY 3BD:1,2,3>insertion_point 3BD:1,1,1>scale BD:.5>rotation 3BD:0,0,1>normal RC:2>flags RC:100>contrast RC:20>fade BS:2 2BD:0,0>clip_polygon.0 2BD:5,5>clip_polygon.1 H:5/44>definition_handle
WIPEOUT WIPEOUT BL:3>clip_state BS:2 2BD:0,0>clip_polygon.0 2BD:5,5>clip_polygon.1 B:1>show_clipped RC:50>brightness RC:60>contrast RC:5>fade
MULTILEADER@2010 MULTILEADER BS:2>class_version BS:2>content_type BS:1>draw_mleader_order_type BS:0>draw_leader_order_type BL:3>max_leader_segments_points BD:.5>first_seg_angle_constraint BD:.25>second_seg_angle_constraint BS:1>leader_type BS:256>line_color H:5/20>linetype_handle BL:25>line_weight B:1>enable_landing B:0>enable_dogleg BD:2>landing_distance BD:3>arrow_head_size BS:2>content_type_again TV:note>mtext_default_text 3BD:0,0,1>text_normal_direction H:5/21>text_style_handle BS:1>text_left_attachment_type BS:2>text_angle_type BS:3>text_alignment_type BS:4>text_color BD:2.5>text_height B:1>text_frame_enabled B:0>use_default_mtext_text 3BD:0,0,1>block_content_normal H:5/22>block_content_handle BS:5>block_content_color 3BD:1,1,1>block_content_scale BD:.75>block_content_rotation BS:6>block_content_connection B:1>is_annotative BS:1 BL:0>arrowhead_overrides.0.index H:5/23>arrowhead_overrides.0.handle BS:1 BL:4>block_labels.0.index BL:9>block_labels.0.value B:1>enable_text_attachment_to_leader B:0>enable_text_attachment_to_dogleg
EXTRUDEDSURFACE EXTRUDEDSURFACE {_SAT} 3BD:1,2,3>sweep_vector BD:.5>draft_angle
REVOLVEDSURFACE REVOLVEDSURFACE {_SAT} 3BD:1,2,3>axis_origin 3BD:0,0,1>axis_direction BD:3>sweep_angle
SWEPTSURFACE SWEPTSURFACE {_SAT} H:5/25>path_handle BB:2>align_option
LOFTEDSURFACE LOFTEDSURFACE B:1>sat.empty BL:2 H:5/25>cross_section_handles.0 H:4/26>cross_section_handles.1 BD:.5>start_tangent_mag BD:.75>end_tangent_mag
HELIX HELIX 3BD:1,2,3>axis_base_point 3BD:4,5,6>start_point 3BD:0,0,1>axis_vector BD:2>radius BD:3>turns BD:.5>turn_height B:1>right_handed BS:1>constrain_type
MESH@2010 MESH BS:2>version B:1>blend_crease BS:3>subdivision_level BS:3 3BD:0,0,0>vertices.0 3BD:1,0,0>vertices.1 3BD:0,1,0>vertices.2 BL:1 BL:3 BL:0>faces.0.0 BL:1>faces.0.1 BL:2>faces.0.2 BL:1 BS:0>edges.0.a BS:1>edges.0.b BD:2>creases.0
"""

TABLES = f"""
BLOCK_RECORD 31 {_TEH} B:0>is_anonymous B:1>has_attribs B:0>is_xref B:1>xref_overlay B:0>is_loaded_xref BL:12>num_owned_objects 3BD:1,2,3>base_point TV:ref.dwg>xref_path
LAYER 33 {_TEH} BS:4>flags B:1>plot_flag BS:25>lineweight BS:3>color_index
STYLE 35 {_TEH} RC:4>flags BD:2>fixed_height BD:.75>width_factor BD:.25>oblique_angle RC:2>generation BD:3>last_height TV:txt.shx>font_filename TV:big.shx>bigfont_filename
LTYPE 39 {_TEH} RC:1>flags RS:2>used_count TV:dashdot>description BD:4>pattern_length RC:65>alignment RC:3 BD:2>dashes.0.length BS:0>dashes.0.flags BD:0>dashes.0.shape_x BD:0>dashes.0.shape_y BD:1>dashes.0.scale BD:0>dashes.0.rotation BS:0>dashes.0.shape_number BD:-1>dashes.1.length BS:2>dashes.1.flags BD:0>dashes.1.shape_x BD:0>dashes.1.shape_y BD:1>dashes.1.scale BD:0>dashes.1.rotation BS:0>dashes.1.shape_number TV:GAS>dashes.1.text BD:-1>dashes.2.length BS:4>dashes.2.flags BD:0>dashes.2.shape_x BD:0>dashes.2.shape_y BD:1>dashes.2.scale BD:0>dashes.2.rotation BS:132>dashes.2.shape_number H:5/40>dashes.2.style_handle
VIEW 3D {_TEH} BD:10>view_height BD:20>view_width 2BD:1,2>view_center 3BD:3,4,5>target 3BD:0,0,1>view_direction BD:.5>twist_angle BD:50>lens_length BD:2>front_clip BD:3>back_clip BS:1>view_mode RC:2>render_mode B:1>is_paperspace B:0>is_associated_ucs
UCS 3F {_TEH} 3BD:1,2,3>origin 3BD:1,0,0>x_axis 3BD:0,1,0>y_axis BD:.5>elevation BS:3>ortho_view_type H:5/12>base_ucs_handle
VPORT 41 {_TEH} BD:10>view_height BD:1.5>aspect_ratio 2BD:1,2>view_center 3BD:3,4,5>view_target 3BD:0,0,1>view_direction BD:.5>view_twist BD:50>lens_length BD:2>front_clip BD:3>back_clip BS:1>view_mode RC:2>render_mode 2RD:0,0>lower_left 2RD:1,1>upper_right B:1>ucs_at_origin B:0>ucs_per_vport 2RD:2,2>snap_base 2RD:3,3>snap_spacing 2RD:4,4>grid_spacing BD:.75>snap_rotation
APPID 43 {_TEH} RC:9>unknown
DIMSTYLE 45 {_TEH} BD:1>dimscale BD:2>dimasz BD:3>dimexo BD:4>dimexe BD:5>dimtxt BD:6>dimcen BD:7>dimtfac BD:8>dimlfac B:1>dimtih B:0>dimtoh RC:1>dimtad RC:2>dimtolj BD:9>dimaltf BD:10>dimaltrnd B:1>dimupt
"""

OBJECTS = """
DICTIONARY 2A BL:2 BS:1>cloning_flag RC:0 =false>hard_owner TV:first>entries.0.name H:2/18>entries.0.handle TV:second>entries.1.name H:3/300>entries.1.handle
XRECORD 4F DATA:xrecord>data BS:1>cloning_flags
CONTROL 32 BL:5>num_entries
ACAD_GROUP 48 TV:Group>name B:0>unnamed B:1>selectable BL:2 H:4/20>member_handles.0 H:5/21>member_handles.1
ACAD_LAYOUT 52 BS:1>flags TV:Sheet>layout_name BS:2>tab_order 2RD:0,0>paper_min_limits 2RD:210,297>paper_max_limits 3BD:0,0,0>insertion_base_point 3BD:1,1,1>min_extents 3BD:9,9,9>max_extents BD:.5>elevation BS:0>ucs_ortho_view_type 3BD:0,0,0>ucs_origin 3BD:1,0,0>ucs_x_axis 3BD:0,1,0>ucs_y_axis H:5/50>plot_settings_handle H:4/51>block_record_handle H:4/52>last_active_viewport_handle H:5/53>base_ucs_handle H:5/54>named_ucs_handle
ACAD_MLINESTYLE 49 TV:Wall>name TV:two_lines>description BS:3>flags BS:7>fill_color BD:1.5>start_angle BD:1.25>end_angle RC:2 BD:.5>lines.0.offset BS:1>lines.0.color BS:0>lines.0.linetype_index BD:-.5>lines.1.offset BS:2>lines.1.color BS:1>lines.1.linetype_index
PROXY_OBJECT 1F3 BL:502>proxy_class_id DATA:proxybytes>raw_proxy_data BL:1 H:3/20>handles.0
ACAD_MATERIAL@2007 MATERIAL TV:Glass>name TV:clear>description BL:1>ambient_color_method BS:7>ambient_color BD:.5>ambient_color_factor BL:1>diffuse_color_method BS:8>diffuse_color BD:.25>diffuse_color_factor BD:.75>specular_color_factor BD:.5>specular_gloss_factor BD:2>reflection_factor BD:3>opacity_factor BD:4>bump_amount BD:5>refraction_factor BD:6>translucence BL:3>self_illumination BD:7>luminance BL:2>luminance_mode
ACAD_PLOTSETTINGS PLOTSETTINGS TV:Setup>page_setup_name TV:plotter>printer_config_name BS:5>flags 2BD:1,2>paper_lower_left 2BD:3,4>paper_upper_right 2BD:5,6>plot_origin BS:1>paper_units BS:2>plot_rotation BS:3>plot_type 2BD:7,8>window_lower_left 2BD:9,10>window_upper_right BD:2>numerator BD:50>denominator BS:1>shade_plot_mode BS:2>shade_plot_resolution_level BS:300>shade_plot_dpi TV:mono.ctb>stylesheet_name B:1>scale_to_fit H:5/60>shade_plot_object_handle
ACAD_PROPERTYSET_DATA AEC_PROPERTY_SET TV:Doors>propset_definition_name BL:3 TV:width>properties.0.name BL:2>properties.0.kind BD:90>properties.0.number TV:count>properties.1.name BL:1>properties.1.kind BL:4>properties.1.whole TV:maker>properties.2.name BL:3>properties.2.kind TV:none>properties.2.text
ACAD_SCALE SCALE TV:1:50>scale_name BD:2>paper_units BD:50>drawing_units BS:1>flag
ACAD_VISUALSTYLE@2007 VISUALSTYLE TV:Wire>description BS:1>face_lighting_model BS:2>face_lighting_quality BS:3>face_color_mode BD:.5>face_opacity BD:.25>face_specular BS:4>face_mono_color BS:5>face_modifier BS:6>edge_model BL:7>edge_style_apply_flags BS:8>edge_intersection_color BS:9>edge_obscured_color BS:10>edge_color BS:11>edge_silhouette_color
CUSTOM_DICTIONARY ACDBDICTIONARYWDFLT BS:2 TV:key>entries.0.name H:2/61>entries.0.handle TV:other>entries.1.name H:2/62>entries.1.handle
IMAGEDEF IMAGEDEF BL:0>class_version 2RD:640,480>image_size_pixels TV:site.png>file_path B:1>is_loaded RC:2>pixel_size_units RD:.5>pixel_width_size RD:.25>pixel_height_size
"""

#: Records that stand inside others or behind a header; they are decoded for themselves.
PARTS = """
XDATA - H:5/9>app_handle BL:8 BS:1000>items.0.code TV:name>items.0.text BS:1004>items.1.code RCDATA:xyz>items.1.data BS:1005>items.2.code H:5/30>items.2.handle BS:1010>items.3.code 3BD:1,2,3>items.3.point BS:1040>items.4.code BD:2>items.4.real BS:1070>items.5.code BS:-3>items.5.short BS:1071>items.6.code BL:70000>items.6.whole BS:1003>items.7.code TV:0>items.7.text
CLASS_MAP_EXTENSION - BS:501>entries.0.class_number BS:1153>entries.0.proxy_flags TV:App>entries.0.app_name TV:AcDbWall>entries.0.cpp_class_name TV:WALL>entries.0.dxf_record_name B:0>entries.0.was_zombie BS:498>entries.0.item_class_id
PROXY_PASSTHROUGH - BL:501>proxy_class_id BL:24>application_version BL:20>data_size_bits BYTES:abc>raw_proxy_data H:4/99>original_object_handle@2007
DIMENSION_LINEAR_SUFFIX - 3BD:1,2,3>extension_line_1_origin 3BD:4,5,6>extension_line_2_origin 3BD:7,8,9>dim_line_definition_point BD:.5>rotation_radians BD:.25>oblique_angle_radians
DIMENSION_ALIGNED_SUFFIX - 3BD:1,2,3>extension_line_1_origin 3BD:4,5,6>extension_line_2_origin 3BD:7,8,9>dim_line_definition_point BD:.25>oblique_angle_radians
DIMENSION_ANG2LN_SUFFIX - 3BD:1,2,3>extension_line_1a 3BD:4,5,6>extension_line_1b 3BD:7,8,9>extension_line_2a 3BD:10,11,12>extension_line_2b
DIMENSION_ANG3PT_SUFFIX - 3BD:1,2,3>center 3BD:4,5,6>first_extension_point 3BD:7,8,9>second_extension_point
DIMENSION_ORDINATE_SUFFIX - 3BD:1,2,3>feature_location 3BD:4,5,6>leader_endpoint RC:1>flags
DIMENSION_RADIUS_SUFFIX - 3BD:1,2,3>center_point 3BD:4,5,6>first_arc_point BD:.5>leader_length
DIMENSION_DIAMETER_SUFFIX - 3BD:1,2,3>center_point 3BD:4,5,6>first_arc_point BD:.5>leader_length
"""


def _le(data: bytes) -> str:
    return "".join(f"{b:08b}" for b in data)


def wire(code: str, text: str, version: int) -> tuple[str, object]:
    """(bits, decoded value) of one value."""
    if code in ("B", "BB", "RC", "RS", "RL", "BS", "BL"):
        v = int(text)
        if code in ("B", "BB"):
            return f"{v:0{len(code)}b}", bool(v) if code == "B" else v
        if code in ("RC", "RS", "RL"):
            return _le(v.to_bytes({"RC": 1, "RS": 2, "RL": 4}[code], "little")), v
        if v == 0:
            return "10", v
        if code == "BS" and v == 256:
            return "11", v
        if 0 < v < 256:
            return "01" + f"{v:08b}", v
        return "00" + _le(struct.pack("<h" if code == "BS" and v < 32768 else "<H" if code == "BS" else "<i", v)), v
    if code in ("BD", "RD"):
        v = float(text)
        short = {0.0: "10", 1.0: "01"}.get(v) if code == "BD" else None
        return short or "00" * (code == "BD") + _le(struct.pack("<d", v)), v
    if code in ("2RD", "2BD", "3BD"):
        parts = [wire(code[1:], t, version) for t in text.split(",")]
        return "".join(b for b, _ in parts), dict(zip("xyz", (v for _, v in parts)))
    if code == "BT":
        return ("1", 0.0) if float(text) == 0 else ("0" + wire("BD", text, version)[0], float(text))
    if code == "BE":
        bits, v = wire("3BD", text, version)
        return ("1" if v == {"x": 0.0, "y": 0.0, "z": 1.0} else "0" + bits), v
    if code == "H":
        kind, value = map(int, text.split("/"))
        size = (value.bit_length() + 7) // 8
        return f"{kind:04b}{size:04b}" + _le(value.to_bytes(size, "big")), {"code": kind, "counter": size, "value": value}
    if code == "TV":
        raw = text.encode("utf-16-le" if version >= 2007 else "utf-8")
        return wire("BS", str(len(raw) // 2 if version >= 2007 else len(raw)), version)[0] + _le(raw), text
    raw = text.encode()
    shown = base64.b64encode(raw).decode()
    size = {"DATA": wire("BL", str(len(raw)), version)[0], "CHUNKS": "1" + wire("BL", str(len(raw)), version)[0], "RCDATA": f"{len(raw):08b}", "BYTES": ""}[code]
    return size + _le(raw) + "0" * (code == "CHUNKS"), shown


def _put(record, place: str, value) -> None:
    """A value at its place in nested objects and lists."""
    at, keys = record, [int(k) if k.isdigit() else k for k in place.split(".")]
    for k, following in zip(keys, keys[1:]):
        empty = [] if isinstance(following, int) else {}
        if isinstance(at, list):
            if k == len(at):
                at.append(empty)
            at = at[k]
        else:
            at = at.setdefault(k, empty)
    if isinstance(at, list):
        at.append(value)
    else:
        at[keys[-1]] = value


def _points(v):
    """Lists of three numbers are points."""
    if isinstance(v, list) and len(v) == 3 and all(isinstance(x, float) for x in v):
        return dict(zip("xyz", v))
    return [_points(x) for x in v] if isinstance(v, list) else v


def encode(text: str, version: int, k: int) -> tuple[str, dict]:
    """(bits, decoded record) of a sample."""
    bits, record = [], {}
    for item in text.split():
        item, _, gate = item.partition("@")
        if gate and (version >= int(gate[1:]) if gate[0] == "<" else version < int(gate)):
            continue
        head, _, place = item.rpartition(">") if ">" in item else (item, "", "")
        if head.startswith("="):
            value = _points(json.loads(head[1:]))
        else:
            code, _, v = head.lstrip("!").partition(":")
            if place and not head.startswith("!") and code in ("BD", "RD", "2RD", "2BD", "3BD"):
                v = ",".join(str(float(x) + k) for x in v.split(","))
            own, value = wire(code, v, version)
            bits.append(own)
        if place and value is not None:
            _put(record, place, value)
    return "".join(bits), record


def _to_bytes(bits: str) -> bytes:
    bits += "0" * (-len(bits) % 8)
    return int(bits or "0", 2).to_bytes(len(bits) // 8, "big")


class Sample:
    def __init__(self, line: str, family: str):
        kind, self.code, self.text = line.split(" ", 2)
        self.kind, _, since = kind.partition("@")
        self.since, self.family = int(since or 0), family


SAMPLES = [Sample(line, family) for family, block in (("entity", ENTITIES), ("table", TABLES), ("object", OBJECTS), ("part", PARTS)) for line in block.strip().split("\n")]
IN_FILES = [s for s in SAMPLES if s.family != "part"]
#: Class numbers by name, in the order of the samples.
CLASSES = {name: 500 + i for i, name in enumerate(dict.fromkeys(s.code for s in IN_FILES if len(s.code) > 3 or not all(c in "0123456789ABCDEF" for c in s.code)))}


def _modular(v: int) -> bytes:
    out, rest = bytearray(), abs(v)
    while rest > 0x3F:
        out.append(0x80 | rest & 0x7F)
        rest >>= 7
    out.append(rest | 0x40 * (v < 0))
    return bytes(out)


def _code(sample: Sample) -> int:
    return CLASSES[sample.code] if sample.code in CLASSES else int(sample.code, 16)


def _framed(code: int, handle: int, body: str, version: int) -> tuple[bytes, bytes, int]:
    """(framed object, its bytes, bit where the body begins)."""
    if version >= 2010:
        head = "0" * 8 + ("00" + f"{code:08b}" if code < 256 else "01" + f"{code - 0x1F0:08b}" if 0x1F0 <= code < 0x2F0 else "10" + _le(code.to_bytes(2, "little")))
    else:
        head = wire("BS", str(code), version)[0]
    head += wire("H", f"0/{handle}", version)[0]
    raw = _to_bytes(head + body)
    return len(raw).to_bytes(2, "little") + raw + b"\0\0", raw, len(head)


def _wide(s: str) -> bytes:
    return (len(s) + 1).to_bytes(2, "little") + s.encode("utf-16-le") + b"\0\0"


def _long(s: str) -> bytes:
    return len(s.encode()).to_bytes(4, "little") + s.encode()


# Marks of the preview and of the header variables.
_PREVIEW = bytes.fromhex("1f256d07d43628289d57ca3f9d44102b")
_HEADER = bytes.fromhex("cf7b1f23fdde38a95f7c68b84e6d335f")


@lru_cache(maxsize=None)
def drawing(version: int, k: int) -> tuple[bytes, dict[str, list[tuple]]]:
    """A file's bytes, and the rows of each table without the path."""
    magic = next(m for m, v in VERSIONS.items() if v == version)
    stream, index, objects = bytes(4), [], []
    for i, s in enumerate(IN_FILES):
        if version < s.since:
            continue
        pre = encode(_PRE, version, 0)[0] if s.family == "entity" else ""
        bits, record = encode(s.text, version, k)
        framed, raw, at = _framed(_code(s), 16 + i, pre + bits, version)
        objects.append((len(stream), len(raw), _code(s), 16 + i, hashlib.md5(raw).hexdigest(), at, s.kind, record))
        index.append((16 + i, len(stream)))
        stream += framed
    pairs, before = b"", (0, 0)
    for h, o in index:
        pairs += _modular(h - before[0]) + _modular(o - before[1])
        before = h, o
    handles = (len(pairs) + 2).to_bytes(2, "big") + pairs + b"\0\0" + b"\0\0"
    classes = [(n, 0, "App", f"AcDb{name.title()}", name, n % 2 == 1, 498) for name, n in CLASSES.items()]
    body = "".join("".join(wire(c, str(int(v)) if c in ("BS", "B") else v, version)[0] for c, v in zip(("BS", "BS", "TV", "TV", "TV", "B", "BS"), row)) for row in classes)
    body = ("0" if version >= 2007 else "") + body
    class_data = bytes(16) + (len(body) + 32).to_bytes(4, "little") + bytes(4) + _to_bytes(body) + bytes(8)
    titles = [f"Plan {k}", "Subject", "A. Author", "", "two\nlines", "Saver", "3", ""]
    dates = [bytes([i, k]) + bytes(6) for i in (1, 2, 3)]
    summary = b"".join(map(_wide, titles)) + b"".join(dates) + (1).to_bytes(2, "little") + _wide("seed") + _wide(str(k))
    app = b"\2\0\0\0" + _wide("AppInfoDataList") + bytes(20) + _wide(f"1.{k}") + bytes(16) + _wide("comment") + bytes(16) + _wide("product")
    image = bytes([7, k])
    preview = _PREVIEW + (60).to_bytes(4, "little") + b"\2" + b"\1" + (39).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"\2" + (42).to_bytes(4, "little") + len(image).to_bytes(4, "little") + b"HDR" + image
    files = [("base.dwg", "/x/base.dwg", "g1", "v1", 0, 100 + k, 2000, True, 1, "Acad:XRef"), ("t.shx", "", "g2", "v2", 5, 7, -1, False, 2, "?")]
    depend = (1).to_bytes(4, "little") + _long("Acad:XRef") + len(files).to_bytes(4, "little")
    for f in files:
        depend += b"".join(map(_long, f[:4])) + struct.pack("<iii", *f[4:7]) + int(f[7]).to_bytes(2, "little") + struct.pack("<i", f[8])
    header = _HEADER + (64).to_bytes(4, "little") + bytes(range(k, k + 8))
    sections = {
        "AcDb:AcDbObjects": stream, "AcDb:AppInfo": app, "AcDb:Classes": class_data, "AcDb:FileDepList": depend, "AcDb:Handles": handles, "AcDb:Header": header, "AcDb:Preview": preview,
        "AcDb:SummaryInfo": summary, "AcDb:Template": b"\1\2\0\0",
    }
    data, places = C.build_with_places(version, sections, maint_version=k, codepage=30, page_size=3000)
    data = bytearray(data)
    data[0x0D:0x11], data[0x20:0x24] = (0x140).to_bytes(4, "little"), (0x160).to_bytes(4, "little")
    tables = {
        "files": [(magic, k, 30, "Full", None)],
        "pages": places["pages"],
        "section_pages": places["section_pages"],
        "sections": [(name, C.SECTIONS[name], places["first"][name], len(content), True, False) for name, content in sections.items()],
        "handle_map": [(i, h, o) for i, (h, o) in enumerate(index)],
        "classes": classes,
        "raw_objects": [o[:6] for o in objects],
        "summary_info": [(*titles, *(d.hex() for d in dates), "seed", str(k))],
        "app_info": [("AppInfoDataList", "", f"1.{k}", "comment", "product")],
        "file_dependencies": files,
        "previews": [(60, image.hex(), b"HDR".hex())],
        "header_variables": [(True, 64, header[20:].hex())],
        "records": [(o[3], o[6], o[7]) for o in objects],
        "payloads": list(sections.items()),
    }
    # what the page map's place tells of a file cut in two
    half = len(data) // 2
    tables["broken"] = [(half, magic, k, 30, "Fallback", f"system page at {places['page_map']} beyond the file")]
    tables["broken_sections"] = [
        ("SectionPageMap", "system_section", places["page_map"], 0, True, False), ("AcDb:SummaryInfo", "summary_info", 0x180, 0, False, False), ("AcDb:Preview", "preview", 0x160, 0, False, False),
        (f"DataPage(decomp={places['first_number']})", "unknown", 0x120, places["first_size"], True, True),
    ]
    return bytes(data), tables


@lru_cache(maxsize=None)
def old_drawing(magic: str) -> tuple[bytes, list[tuple]]:
    """A file with a table of locators (before 2004) or a header that is told only (2007), and its sections."""
    head = bytearray(0x100)
    head[:6] = magic.encode()
    head[0x0B], head[0x13:0x15] = 1, (29).to_bytes(2, "little")
    if magic == "AC1021":
        return bytes(head), []
    rows = [(0, 0x100, 10), (1, 0x10A, 4), (2, 0x10E, 6)]
    head[0x15:0x19] = len(rows).to_bytes(4, "little")
    for i, row in enumerate(rows):
        head[0x19 + 9 * i : 0x22 + 9 * i] = struct.pack("<BII", *row)
    names = ("AcDb:Header", "AcDb:Classes", "AcDb:Handles")
    return bytes(head) + b"\1" * 14 + (2).to_bytes(2, "big") + bytes(4), [(n, C.SECTIONS[n], o, s, False, False) for n, (_, o, s) in zip(names, rows)]


def content_of(path: str, magic: str | None) -> bytes:
    """The file of a drawing of the files table."""
    if magic not in VERSIONS:
        return old_drawing(magic or "")[0]
    data = drawing(VERSIONS[magic], len(path) % CONTENTS)[0]
    return data[: len(data) // 2] if len(path) % 17 == BROKEN else data


# SQL of what the tables hold

FILES = f"(select path, max(version) as version, length(path) % {CONTENTS} as k, length(path) % 17 = {BROKEN} as broken from files group by path)"


def _literal(v) -> str:
    if v is None:
        return "null"
    return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def expected_sql(table: str, columns: str) -> str:
    """The rows of a table for every sound file of a paged version."""
    rows = [(m, k, *row) for m, v in VERSIONS.items() for k in range(CONTENTS) for row in drawing(v, k)[1][table]]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"select path, {columns} from {FILES} f join (values {values}) t(version_, k_, {columns}) on version = version_ and k = k_ where not broken"


def records_sql(kind: str) -> str:
    """Records of a kind as JSON."""
    rows = [(m, k, handle, "ok", json.dumps(rec, ensure_ascii=False, separators=(",", ":"))) for m, v in VERSIONS.items() for k in range(CONTENTS) for handle, own, rec in drawing(v, k)[1]["records"] if own == kind]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"select path, cast(handle as bigint) as handle, status, record from {FILES} f join (values {values}) t(version_, k_, handle, status, record) on version = version_ and k = k_ where not broken"


def part_record(kind: str, version: int, k: int) -> tuple[bytes, str]:
    """(bytes, JSON) of a record that stands inside others."""
    s = next(s for s in SAMPLES if s.kind == kind)
    bits, rec = encode(s.text, version, k)
    return _to_bytes(bits), json.dumps(rec, ensure_ascii=False, separators=(",", ":"))


def part_sql(kind: str) -> str:
    rows = [(m, k, part_record(kind, v, k)[1]) for m, v in VERSIONS.items() for k in range(CONTENTS)]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"select path, 'ok' as status, record from {FILES} f join (values {values}) t(version_, k_, record) on version = version_ and k = k_"
