"""Schemas of the tables that searches run over. Ordinals carry the order that rankings depend on."""

MANIFEST_VERSION = 2

ARTIFACT = "struct<coordinates:string,configuration:string,kind:string,binaryJar:string,sourcesJar:string,sourceDir:string,noDecompile:boolean>"
MANIFEST = f"version int, resolvedAt string, dependencySetHash string, artifacts array<{ARTIFACT}>"
ENTRY = "archive string, entry_ord long, name string, csize long, usize long, method int, crc long, is_dir boolean, error string"
DUMP = "configurations array<struct<name:string,dependencies:array<struct<coordinates:string,kind:string,path:string>>,error:string>>, sources map<string,string>"
