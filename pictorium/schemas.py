"""Fixed schemas of the stored tables."""

METADATA = (
    "struct<line_number:int,file_extension:string,description_length:int,word_count:int>"
)
FLAGS = (
    "struct<has_characters:boolean,characters:array<struct<type:string,count:int>>,"
    "has_dogs:boolean,dogs:array<struct<type:string,count:int>>,"
    "has_cars:boolean,cars:array<struct<type:string,count:int>>>"
)
FACE = (
    "struct<has_faces:boolean,face_count:bigint,has_known_faces:boolean,"
    "known_faces:array<struct<match_confidence:double,reference_image:string,distance:double>>>"
)
# ``keywords`` holds a list of tags, an object of flags or an empty object: read as JSON text.
PHOTO_JSON = (
    "filename string, description string, full_path string, keywords string, "
    f"metadata {METADATA}, uploaded_at string, face_recognition {FACE}"
)
DOCUMENT_HEADER = "total_photos bigint, source_file string, source_directory string, conversion_info string"
SEARCH_LOG = (
    "timestamp timestamp_ntz, query string, expanded_query string, results_count int, "
    "top_score double, top_3_avg double, filters map<string,boolean>"
)
VECTORS = "photo_id bigint, model_name string, embedding array<float>"
