"""The canonical class row: one nested row per class, so that features are narrow projections."""

XREF = "array<struct<peer_is_class:boolean,peer_access:string>>"
METHODS = f"array<struct<idx:int,declared:boolean,analysed:boolean,is_external:boolean,descriptor:string,access:string,opcodes:array<int>,xref_from:{XREF},xref_to:{XREF}>>"
FIELDS = "array<struct<idx:int,declared:boolean,analysed:boolean,descriptor:string,access:string,n_read:bigint,n_write:bigint,init_value:string>>"
KINDS = "array<struct<peer:string,kind:string>>"
ROOT = "Ljava/lang/Object;"

CLASS = f"snapshot string, class_name string, is_internal boolean, access_flags string, extends string, implements array<string>, methods {METHODS}, fields {FIELDS}, xref_from {KINDS}, xref_to {KINDS}"
