"""Row types of the code graph, as DDL strings (every field nullable unless a key)."""

FILES = "file_path string, language string, content string, sha256 string, size bigint"
NODES = "file_path string, symbol_name string, symbol_type string, line_number int, signature string"
RAW_EDGES = "file_path string, source string, target string, edge_type string, line_number int"
EDGES = "src_file string, src_name string, src_type string, src_line int, dst_file string, dst_name string, dst_type string, dst_line int, edge_type string, call_line int"
SYMBOLS = "name string, symbol_type string, line_number int, signature string, file_path string, docstring string, parent string, ordinal int"
ISSUES = "file_path string, check string, line int, column int, code string, message string, severity string"
ISSUE = "struct<line:int,column:int,code:string,message:string,severity:string>"
MANIFEST = "file_path string, hash string, updated_at double"

# Directory names that scans leave out, for the graph and for symbol search.
GRAPH_EXCLUDED = ("venv", ".venv", "node_modules", ".git", "__pycache__", ".mypy_cache", "dist", "build", ".tox", ".eggs")
SEARCH_EXCLUDED = ("venv", ".venv", "node_modules", ".git", "__pycache__", ".mypy_cache", "dist", "build")

# Symbols of well-known libraries.
KNOWN_SYMBOLS = {
    "python": "print len range str int list dict set tuple bool float open input type isinstance enumerate zip map filter sorted reversed sum min max abs round any all hash id dir getattr setattr hasattr callable iter next slice",
    "fastapi": "FastAPI APIRouter Depends Body Path Query Header Cookie HTTPException Response JSONResponse Request UploadFile File Form",
    "pydantic": "BaseModel Field validator root_validator ValidationError EmailStr HttpUrl PositiveInt NegativeFloat constr conint conlist",
    "numpy": "array zeros ones eye linspace arange reshape dot matmul transpose sum mean std max min argmax argmin where concatenate stack split",
    "pandas": "DataFrame Series read_csv read_excel read_sql concat merge groupby pivot_table crosstab cut qcut get_dummies to_datetime",
    "django": "Model View TemplateView Form ModelForm QuerySet HttpResponse HttpRequest middleware admin settings urls",
    "flask": "Flask Blueprint request response render_template redirect url_for session g abort jsonify",
    "sqlalchemy": "create_engine Column Integer String ForeignKey relationship declarative_base sessionmaker Session select insert update delete",
    "react": "useState useEffect useContext useReducer useCallback useMemo useRef createContext forwardRef memo Suspense lazy",
}
