"""Relations over source code: names and columns.

Columns are entity ids unless marked ``:int`` or ``:str``; all are stored as
64-bit integers or strings, without nulls.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The relations of code facts, those derived by rules included.
TEXT = """
File id path:str contentHash:str
Node id file kind:str startLine:int startCol:int endLine:int endCol:int
Contains parent child
Symbol id name:str declNode declFile
FunctionSymbol sym fn
Function id name:str isArrow:int isAsync:int isGenerator:int isMethod:int
Parameter fn idx:int name:str paramNode sym typeText:str
ParameterRest fn idx:int
ParameterOptional fn idx:int
ParameterDestructured fn idx:int
ParamDestructurePattern paramNode patternNode
ParamIsFunctionType fn idx:int
JsxExpressionInner wrapperNode innerNode
Call id calleeNode arity:int
CallArg call idx:int argNode
CallArgSpread call idx:int
CallCalleeSym call sym
CallResultSym call sym
VarDecl id sym initExpr isConst:int
Assign lhsNode rhsExpr lhsSym
ExprMayRef expr sym
ExprIsCall expr call
FieldRead expr baseSym fieldName:str
FieldWrite assignNode baseSym fieldName:str rhsExpr
Await expr innerExpr
Cast expr innerExpr
DestructureField parent sourceField:str bindName:str bindSym idx:int
ArrayDestructure parent idx:int bindSym
DestructureRest parent bindSym
ImportBinding localSym moduleSpec:str importedName:str
ExportBinding exportedName:str localSym file
TypeFromLib sym libName:str
ObjectLiteralField parent fieldName:str valueExpr
ObjectLiteralSpread parent valueExpr
JsxElement id tagNode tagSym
JsxAttribute element name:str valueExpr
ClassDecl id name:str file
InterfaceDecl id name:str file
Implements classId interfaceId
Extends childId parentId
MethodDecl classOrIfaceId name:str fnId
MethodCall callId receiverExpr methodName:str
NewExpr callId classId
ExprType exprId typeId
TypeDecl typeId name:str kind:str file
ReturnStmt fnId stmtNode returnExpr
FunctionContains fnId nodeId
SymInFunction sym fnId
ExprInFunction exprId fnId
ReturnSym fnId sym
CallTarget call fn
CallTargetRTA call fn
CallTargetCrossModule call fn
Instantiated classId
MethodDeclDirect classId name:str fn
MethodDeclInherited childId name:str fn
LocalFlow fnId srcSym dstSym
LocalFlowStar fnId srcSym dstSym
ParamToReturn fnId paramIdx:int
ParamToCallArg fnId paramIdx:int calleeSym argIdx:int
ParamToFieldWrite fnId paramIdx:int fieldName:str
ParamToSink fnId paramIdx:int sinkKind:str
SourceToReturn fnId sourceKind:str
CallReturnToReturn fnId callId
InterFlow srcSym dstSym
FlowStar srcSym dstSym
TaintSink sinkExpr sinkKind:str
TaintSource srcExpr sourceKind:str
Sanitizer fnId kind:str
TaintedSym sym kind:str
TaintedField baseSym fieldName:str kind:str
SanitizedEdge srcSym dstSym kind:str
TaintAlert srcExpr sinkExpr srcKind:str sinkKind:str
AdditionalTaintStep srcSym dstSym
AdditionalFlowStep srcSym dstSym
ExpressHandler fnId
ResolvedType typeId displayName:str
SymbolType sym typeId
NonTaintableType typeId
TypeInfo typeId kind:str displayName:str
TypeMember typeId memberName:str memberTypeId
UnionMember unionTypeId memberTypeId
IntersectionMember intersectionTypeId memberTypeId
GenericInstantiation instanceTypeId genericTypeId argIdx:int argTypeId
TypeAlias aliasTypeId aliasedTypeId
TypeParameter declId idx:int name:str constraintTypeId
ExprValueSource expr sourceExpr
AssignExpr lhsSym rhsExpr
ParamBinding fn paramIdx:int paramSym argExpr
LocalFlowStep from to
InterFlowStep from to
FlowStep from to
MayResolveTo v s
MayResolveToCapHit queryId rulePred:str lastDeltaSize:int
TemplateLiteral id tag
TemplateElement parentId idx:int rawText:str
TemplateExpression parentId idx:int exprId
EnumDecl id name:str file
EnumMember enumId memberName:str initExpr
OptionalChain expr baseExpr
NullishCoalescing expr lhs rhs
Decorator targetId decoratorExpr
NamespaceDecl id name:str file
NamespaceMember nsId memberId
TypeGuard fnId paramIdx:int narrowedType:str
ExtractError file nodeStartLine:int phase:str message:str
SchemaVersion version:int
"""


def _parse() -> dict[str, list[tuple[str, str]]]:
    out = {}
    for line in TEXT.strip().splitlines():
        name, *cols = line.split()
        out[name] = [tuple(c.split(":")) if ":" in c else (c, "ref") for c in cols]
    return out


#: name: [(column, "ref" | "int" | "str"), ...]
RELATIONS: dict[str, list[tuple[str, str]]] = _parse()


def schema(name: str) -> T.StructType:
    kinds = {"ref": T.LongType(), "int": T.LongType(), "str": T.StringType()}
    return T.StructType([T.StructField(c, kinds[k], False) for c, k in RELATIONS[name]])


def entity(name: str) -> tuple[str, int] | None:
    """The relation of an entity type: call_arg belongs to CallArg."""
    camel = "".join(p.capitalize() for p in name.split("_"))
    found = next((r for r in RELATIONS if r.lower() == camel.lower()), None)
    return (found, len(RELATIONS[found])) if found else None
