"""Bundled grammars, as EBNF text for :mod:`.chart`.

Quoted words are literal tokens, upper-case names token classes, lower-case
names rules.  The grammars cover the languages' statement, declaration, type
and expression syntax; no rule begins with itself.
"""

from __future__ import annotations


def _words(names: str) -> str:
    return " | ".join(f"'{x}'" for x in names.split())


_JS_RESERVED = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with enum true false null"
_JS_SOFT = "let yield await async of get set static from as"
_TS_SOFT = _JS_SOFT + " type interface implements readonly public private protected abstract override declare namespace module keyof infer is asserts satisfies unique require accessor"
_JS_BINARY = "+ - * / % ** == != === !== <= && || ?? & | ^ << in instanceof = += -= *= /= %= **= &= |= ^= &&= ||= ??= <<= <"


def _ecmascript(typed: bool) -> str:
    ann = "(':' type)?" if typed else ""
    ret = "(':' rettype)?" if typed else ""
    tpar = "typarams?" if typed else ""
    targs = "typeargs?" if typed else ""
    mark = "'?'?" if typed else ""
    mods = _words("static async get set" + (" readonly public private protected abstract override declare accessor" if typed else "")) + " | '*'"
    soft = _words(_TS_SOFT if typed else _JS_SOFT)
    types = """
    type: union ('extends' union '?' type ':' type)? | typarams? '(' params ')' '=>' rettype | 'abstract'? 'new' typarams? '(' params ')' '=>' type;
    rettype: type | 'asserts'? (id | 'this') 'is' type | 'asserts' id;
    union: '|'? inter ('|' inter)*;
    inter: '&'? typost ('&' typost)*;
    typost: ('keyof' | 'readonly' | 'unique' | 'infer')* typrim ('[' type? ']')*;
    typrim: id ('.' name)* typeargs? | STR | TPL | '-'? NUM | '{' tymembers '}' | '[' (tyelem (',' tyelem)* ','?)? ']' | '(' type ')'
        | 'this' | 'true' | 'false' | 'null' | 'void' | 'typeof' id ('.' name)* typeargs? | 'import' '(' STR ')' ('.' name)* typeargs?;
    tyelem: '...'? (id '?'? ':')? type '?'?;
    typeargs: '<' type (',' type)* ','? '>';
    typarams: '<' typaram (',' typaram)* ','? '>';
    typaram: 'const'? id ('extends' type)? ('=' type)?;
    tymembers: (tymember? (';' | ',' | NL))* tymember?;
    tymember: ('readonly' | '+' 'readonly' | '-' 'readonly')? (propname '?'? (':' type)? | '[' id ':' type ']' ':' type | '[' id 'in' type ('as' type)? ']' ('?' | '+' '?' | '-' '?')? (':' type)?)
        | ('get' | 'set')? propname '?'? typarams? '(' params ')' (':' rettype)? | 'new'? typarams? '(' params ')' (':' rettype)?;
    types: type (',' type)*;
    tsdecl: 'interface' id typarams? ('extends' types)? '{' tymembers '}' | 'const'? 'enum' id '{' (propname ('=' assign)? (',' propname ('=' assign)?)* ','?)? '}'
        | ('namespace' | 'module') (id ('.' id)* | STR) block | 'declare' 'global' block | 'abstract' class | 'declare' (tsdecl | funchead | class | vardecl e | 'module' STR e)
        | funchead e;
    funchead: 'async'? 'function' '*'? id typarams? '(' params ')' (':' rettype)?;
    """ if typed else ""
    tystmt = "| tsdecl" if typed else ""
    tysimple = "| 'type' id typarams? '=' type | 'export' 'type' id typarams? '=' type | 'import' id '=' 'require' '(' STR ')' | 'export' '=' expr" if typed else ""
    typost = "| '!' | typeargs (args | TPL)?" if typed else ""
    tycast = "| ('as' | 'satisfies') (type | 'const')" if typed else ""
    tyarrow = "typarams?" if typed else ""
    tyimport = "'type'?" if typed else ""
    tyimplements = "('implements' types)?" if typed else ""
    return f"""
    file: stmt*;
    e: ';' | NL;
    block: '{{' body '}}';
    body: stmt* last?;
    stmt: ';' | block | simple e | 'if' '(' expr ')' sub ('else' sub)? | 'for' 'await'? '(' forhead ')' sub | 'while' '(' expr ')' sub
        | 'do' sub 'while' '(' expr ')' ';'? | 'switch' '(' expr ')' '{{' (('case' expr | 'default') ':' body)* '}}'
        | 'try' block ('catch' ('(' bind {ann} ')')? block ('finally' block)? | 'finally' block)
        | function | decorated | id ':' stmt | 'export' 'default'? (function | decorated {tystmt}) {tystmt};
    sub: stmt;
    last: simple {"| 'export'? 'declare'? funchead" if typed else ""} | ('if' '(' expr ')' | 'for' '(' forhead ')' | 'while' '(' expr ')') last | 'if' '(' expr ')' sub 'else' last;
    simple: 'const' cdecl (',' cdecl)* | vardecl | exprs | 'return' expr? | 'break' id? | 'continue' id? | 'throw' expr | 'debugger'
        | import | 'export' ('const' cdecl (',' cdecl)* | vardecl | 'default' assign0 | {tyimport} names ('from' STR)? | {tyimport} '*' ('as' (name | STR))? 'from' STR) {tysimple};
    vardecl: ('let' | 'var') vdecl (',' vdecl)*;
    cdecl: bind {ann} '=' assign;
    vdecl: bind {"'!'?" if typed else ""} {ann} ('=' assign)?;
    forhead: ('const' | 'let' | 'var') bind {ann} ('of' | 'in') expr | opnd 'of' expr | ('const' cdecl (',' cdecl)* | vardecl | expr)? ';' expr? ';' expr?;
    import: 'import' STR with? | 'import' {tyimport} (id (',' ('*' 'as' id | names))? | '*' 'as' id | names) 'from' STR with?;
    with: ('with' | 'assert') '{{' props '}}';
    names: '{{' (spec (',' spec)* ','?)? '}}';
    spec: {tyimport} (name | STR) ('as' (name | STR))?;
    bind: id | '[' bindel? (',' bindel?)* ']' | '{{' (bindprop (',' bindprop)* ','?)? '}}';
    bindel: '...'? bind ('=' assign)?;
    bindprop: '...' id | id ('=' assign)? | propname ':' bind ('=' assign)?;
    function: 'async'? 'function' '*'? id? {tpar} '(' params ')' {ret} block;
    params: (param (',' param)* ','?)?;
    param: decorator* {"('public' | 'private' | 'protected' | 'readonly' | 'override')*" if typed else ""} '...'? (bind {"| 'this'" if typed else ""}) {mark} {ann} ('=' assign)?;
    decorator: '@' (id ('.' name)* args? | '(' expr ')');
    decorated: decorator* {"'abstract'?" if typed else ""} class;
    class: 'class' id? {tpar} ('extends' opnd {targs})? {tyimplements} '{{' (member | NL)* lastfield? '}}';
    member: ';' | field e | decorator* mods* propname {mark} {tpar} '(' params ')' {ret} (block {"| e" if typed else ""}) | 'static' block {"| '[' id ':' type ']' ':' type e" if typed else ""};
    lastfield: field {"| decorator* mods* propname '?'? typarams? '(' params ')' (':' rettype)?" if typed else ""};
    field: decorator* mods* propname {"('?' | '!')?" if typed else ""} {ann} ('=' assign)?;
    mods: {mods};
    propname: name | STR | NUM | '[' assign ']' | '#' name;
    name: id | {_words(_JS_RESERVED)};
    id: ID | {soft};
    exprs: start (',' assign)*;
    expr: assign (',' assign)*;
    assign: opnd tail* | arrow | 'yield' '*'? assign?;
    assign0: assign;
    start: opnd0 tail* | arrow | 'yield' '*'? assign?;
    tail: binop assign1 | '?' assign ':' assign {tycast};
    assign1: opnd | arrow | 'yield' '*'? assign?;
    binop: {_words(_JS_BINARY)} | '>' ('>' ('>')?)? '='? | '>=';
    opnd: prefix* primary postfix*;
    opnd0: prefix+ primary postfix* | primary0 postfix*;
    prefix: '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new';
    primary: primary0 | '{{' props '}}' | function | decorated;
    primary0: id | NUM | STR | TPL | RE | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | '[' (arg? (',' arg?)*) ']' | 'import' '(' expr ')' | 'import' '.' name | 'new' '.' name | '#' name;
    postfix: '.' (name | '#' name) | '?.' (name | '[' expr ']' | args | '#' name) | '[' expr ']' | args | TPL | '++' | '--' {typost};
    args: '(' (arg (',' arg)* ','?)? ')';
    arg: '...'? assign;
    arrow: 'async'? (id | {tyarrow} '(' params ')' {ret}) '=>' (block | assign);
    props: (prop (',' prop)* ','?)?;
    prop: '...' assign | id ('=' assign)? | propname ':' assign | mods* propname {tpar} '(' params ')' {ret} block;
    {types}
    """


_PY_BINARY = "+ - * / // % ** @ & | ^ << >> == != < > <= >= in is and or"
PYTHON = f"""
    file: stmt*;
    stmt: line | compound | '@' namedexpr END | END;
    line: small (';' small)* ';'? END;
    suite: line | END INDENT stmt+ DEDENT;
    compound: 'if' namedexpr ':' suite ('elif' namedexpr ':' suite)* ('else' ':' suite)? | 'while' namedexpr ':' suite ('else' ':' suite)?
        | 'async'? 'for' targets 'in' starlist ':' suite ('else' ':' suite)?
        | 'try' ':' suite (('except' '*'? (namedexpr (',' namedexpr)* ('as' id)?)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite)
        | 'async'? 'with' ('(' withitem (',' withitem)* ','? ')' | withitem (',' withitem)*) ':' suite
        | 'async'? 'def' id typarams? '(' params ')' ('->' starlist)? ':' suite | 'class' id typarams? args? ':' suite
        | 'match' starlist ':' END INDENT ('case' starlist ('as' id)? ('if' namedexpr)? ':' suite)+ DEDENT;
    withitem: test ('as' opnd)?;
    typarams: '[' typaram (',' typaram)* ','? ']';
    typaram: ('*' | '**')? id (':' test)? ('=' starlist)?;
    params: (param (',' param)* ','?)?;
    param: id (':' test)? ('=' test)? | '*' (id (':' starred)?)? | '**' id (':' test)? | '/';
    small: starlist (':' test ('=' starlist)? | ('=' starlist)+ | augment starlist)? | 'pass' | 'break' | 'continue' | 'return' starlist? | 'raise' (test ('from' test)?)?
        | 'global' id (',' id)* | 'nonlocal' id (',' id)* | 'del' targets | 'assert' test (',' test)? | 'import' dotted ('as' id)? (',' dotted ('as' id)?)*
        | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | importname (',' importname)* | '(' importname (',' importname)* ','? ')') | 'type' id typarams? '=' test;
    importname: id ('as' id)?;
    dotted: id ('.' id)*;
    augment: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=';
    targets: starred (',' starred)* ','?;
    starlist: yield | starred (',' starred)* ','?;
    yield: 'yield' ('from' test | starlist)?;
    starred: '*' test | namedexpr;
    namedexpr: test (':=' test)?;
    test: or ('if' or 'else' test)? | 'lambda' lparams ':' test;
    lparams: (lparam (',' lparam)* ','?)?;
    lparam: id ('=' test)? | '*' id? | '**' id | '/';
    or: opnd (binop opnd)*;
    binop: {_words(_PY_BINARY)} | 'not' 'in' | 'is' 'not';
    opnd: ('+' | '-' | '~' | 'not' | 'await')* atom post*;
    atom: id | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' (yield | items)? ')' | '[' items? ']' | '{{' (pairs | items)? '}}';
    items: starred (compfor+ | (',' starred)* ','?);
    pairs: pair (compfor+ | (',' pair)* ','?);
    pair: test ':' test | '**' or;
    compfor: 'async'? 'for' targets 'in' or ('if' test | 'if' 'lambda' lparams ':' test)*;
    post: '.' id | args | '[' slice (',' slice)* ','? ']';
    slice: starred | test? ':' test? (':' test?)?;
    args: '(' (arg (',' arg)* ','?)? ')';
    arg: id '=' test | '*' test | '**' test | namedexpr compfor*;
    id: ID | 'match' | 'case' | 'type';
"""

_GO_BINARY = "+ - * / % & | ^ << >> &^ == != < <= > >= && || <-"
GO = f"""
    file: ('package' ID ';' (import ';')* (decl ';')*)?;
    import: 'import' (spec | '(' (spec ';')* spec? ')');
    spec: (ID | '.')? STR;
    decl: 'func' recv? ID typarams? sig block? | simpledecl;
    simpledecl: ('var' | 'const') (varspec | '(' (varspec ';')* varspec? ')') | 'type' (typespec | '(' (typespec ';')* typespec? ')');
    varspec: ids type? ('=' exprs)?;
    typespec: ID typarams? '='? type;
    ids: ID (',' ID)*;
    recv: '(' params ')';
    typarams: '[' ids constraint (',' ids constraint)* ','? ']';
    constraint: ('~'? type) ('|' '~'? type)*;
    sig: '(' params ')' result?;
    result: type | '(' params ')';
    params: (param (',' param)* ','?)?;
    param: ID? '...'? type;
    type: ID ('.' ID)? ('[' type (',' type)* ']')? | '*' type | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | ('<-' 'chan' | 'chan' '<-'?) type
        | 'func' sig | 'struct' '{{' (structfield ';')* structfield? '}}' | 'interface' '{{' (ifacemember ';')* ifacemember? '}}' | '(' type ')';
    structfield: (ids type | '*'? ID ('.' ID)?) STR?;
    ifacemember: ID sig | constraint;
    block: '{{' stmts '}}';
    stmts: (stmt? ';')* stmt?;
    stmt: simpledecl | simple | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | 'go' expr | 'defer' expr | block | if
        | 'for' (range | (simple? ';' simple? ';' simple?) | simple)? block | 'switch' (simple? ';')? simple? '{{' (('case' exprs | 'default') ':' stmts)* '}}'
        | 'switch' (simple ';')? (ID ':=')? operand '.' '(' 'type' ')' '{{' (('case' type (',' type)* | 'default') ':' stmts)* '}}'
        | 'select' '{{' (('case' simple | 'default') ':' stmts)* '}}' | ID ':' stmt?;
    if: 'if' (simple? ';')? expr block ('else' (if | block))?;
    range: (exprs (':=' | '='))? 'range' expr;
    simple: exprs ('++' | '--' | assignop exprs)?;
    assignop: '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
    exprs: expr (',' expr)*;
    expr: unary (binop unary)*;
    binop: {_words(_GO_BINARY)};
    unary: ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* operand;
    operand: primary post*;
    primary: NUM | STR | CHR | ID | '(' (expr | type) ')' | 'func' sig block | littype literal | conv '(' expr ','? ')' | ('make' | 'new') args;
    conv: '[' ']' type | 'map' '[' type ']' type | 'chan' type | 'interface' '{{' '}}' | 'func' sig;
    littype: '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'struct' '{{' (structfield ';')* structfield? '}}' | ID ('.' ID)? ('[' type (',' type)* ']')?;
    literal: '{{' (element (',' element)* ','?)? '}}';
    element: (value ':')? value;
    value: expr | literal;
    post: '.' ID | '.' '(' type ')' | '[' expr? (':' expr? (':' expr)?)? ']' | '[' type (',' type)* ']' | args;
    args: '(' ((expr | type) (',' (expr | type))* '...'? ','?)? ')';
"""

_JAVA_MODS = "public private protected static final abstract native synchronized transient volatile strictfp default sealed"
_JAVA_SOFT = "var record yield sealed permits non when module"
_JAVA_BASIC = "boolean byte char short int long float double"
JAVA = f"""
    file: (mod* 'package' qname ';')? (import | ';')* (typedecl | ';')*;
    import: 'import' 'static'? id ('.' id)* ('.' '*')? ';';
    qname: id ('.' id)*;
    annotation: '@' qname ('(' (annarg (',' annarg)*)? ')')?;
    annarg: (id '=')? annvalue;
    annvalue: expr | annotation | '{{' (annvalue (',' annvalue)*)? ','? '}}';
    mod: {_words(_JAVA_MODS)} | 'non' '-' 'sealed' | annotation;
    typedecl: mod* typebody;
    typebody: 'class' id typarams? ('extends' type)? ('implements' types)? ('permits' types)? '{{' member* '}}'
        | 'interface' id typarams? ('extends' types)? ('permits' types)? '{{' member* '}}' | '@' 'interface' id '{{' member* '}}'
        | 'enum' id ('implements' types)? '{{' (enumconst (',' enumconst)* ','?)? (';' member*)? '}}'
        | 'record' id typarams? '(' params ')' ('implements' types)? '{{' member* '}}';
    enumconst: annotation* id args? ('{{' member* '}}')?;
    member: ';' | 'static'? block | mod* (typebody | typarams? (type | 'void') id '(' params ')' dims ('throws' types)? (block | ('default' annvalue)? ';')
        | typarams? id '(' params ')' ('throws' types)? block | id block | type declarator (',' declarator)* ';');
    declarator: id dims ('=' init)?;
    init: expr | '{{' (init (',' init)*)? ','? '}}';
    dims: (annotation* '[' ']')*;
    params: (param (',' param)*)?;
    param: mod* type (annotation* '...')? (id dims | (id '.')? 'this');
    typarams: '<' typaram (',' typaram)* '>';
    typaram: annotation* id ('extends' type ('&' type)*)?;
    types: type (',' type)*;
    type: annotation* (({_words(_JAVA_BASIC)}) | cname ('.' annotation* cname)*) dims;
    cname: id typeargs?;
    typeargs: '<' (typearg (',' typearg)*)? '>';
    typearg: annotation* '?' (('extends' | 'super') type)? | type;
    block: '{{' blockstmt* '}}';
    blockstmt: mod* (typebody | localvar ';') | stmt;
    localvar: type declarator (',' declarator)*;
    stmt: ';' | block | exprstmt ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
        | 'for' '(' ((mod* localvar | exprs)? ';' expr? ';' exprs? | mod* type id ':' expr) ')' stmt | 'return' expr? ';' | 'break' id? ';' | 'continue' id? ';' | 'throw' expr ';' | 'yield' expr ';'
        | 'assert' expr (':' expr)? ';' | 'synchronized' '(' expr ')' block | id ':' stmt | switch
        | 'try' resources? block (('catch' '(' mod* type ('|' type)* id ')' block)+ ('finally' block)? | 'finally' block) | 'try' resources block;
    resources: '(' resource (';' resource)* ';'? ')';
    resource: mod* localvar | expr;
    switch: 'switch' '(' expr ')' '{{' (('case' caselabel (',' caselabel)* ('when' expr)? | 'default') (':' blockstmt* | '->' (exprstmt ';' | block | 'throw' expr ';')))* '}}';
    caselabel: expr | 'default' | type id | cname '(' (type id (',' type id)*)? ')';
    exprs: expr (',' expr)*;
    exprstmt: ('++' | '--')+ opnd | mutable;
    mutable: primary post* (assignop expr | '++' | '--' | callpost);
    callpost: args | '.' typeargs? id args | '.' 'new' id typeargs? args ('{{' member* '}}')? | ;
    expr: opnd (binop opnd | 'instanceof' mod* type (id | '(' (type id (',' type id)*)? ')')? | '?' expr ':' expr)* | lambda;
    binop: assignop | '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '<' | '>' '='? | '>' '>' '>'? ;
    assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '>'? '=';
    opnd: ('+' | '-' | '!' | '~' | '++' | '--' | '(' type ('&' type)* ')')* (primary post* ('++' | '--')* | lambda);
    lambda: (id | '(' params ')' | '(' id (',' id)* ')') '->' (expr | block);
    primary: NUM | STR | CHR | 'true' | 'false' | 'null' | 'this' | 'super' | id | '(' expr ')' | switch | 'new' annotation* newtype | type ('::' ('new' | id) | '.' 'class') | 'void' '.' 'class';
    newtype: (({_words(_JAVA_BASIC)}) | cname ('.' cname)*) (args ('{{' member* '}}')? | ('[' expr ']')+ dims | '[' ']' dims '{{' (init (',' init)*)? ','? '}}');
    post: '.' (typeargs? id | 'this' | 'class' | 'new' id typeargs? args | 'super') | '[' expr ']' | args | '::' ('new' | id);
    args: '(' (expr (',' expr)*)? ')';
    id: ID | {_words(_JAVA_SOFT)};
"""

_RUST_BINARY = "+ - * / % ^ & | && || << == != < <= = += -= *= /= %= ^= &= |= <<= .. ..="
RUST = f"""
    file: inner* item*;
    inner: '#' '!' tree;
    attr: '#' tree;
    tree: '[' any* ']' ;
    any: token | '(' any* ')' | '[' any* ']' | '{{' any* '}}';
    token: word | NUM | STR | CHR | LIFE | {_words("+ - * / % ^ ! & | && || << <<= += -= *= /= %= ^= &= |= == != < <= > = @ _ . .. ... ..= , ; : :: -> => # $ ?")};
    item: attr* (vis? itembody | id '!' id? ('(' any* ')' ';' | '[' any* ']' ';' | '{{' any* '}}'));
    vis: 'pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')?;
    itembody: fn | 'struct' ID generics? where? ('{{' fields '}}' | '(' tfields ')' where? ';' | ';') | 'union' ID generics? where? '{{' fields '}}'
        | 'enum' ID generics? where? '{{' (variant (',' variant)* ','?)? '}}' | 'unsafe'? 'impl' generics? '!'? type ('for' type)? where? '{{' inner* item* '}}'
        | 'unsafe'? 'trait' ID generics? (':' bounds?)? where? '{{' item* '}}' | 'mod' ID (';' | '{{' inner* item* '}}') | 'use' usetree ';'
        | ('const' | 'static' 'mut'?) (ID | '_') (':' type)? ('=' expr)? ';' | 'type' ID generics? (':' bounds?)? where? ('=' type)? where? ';' | 'extern' 'crate' (ID | 'self') ('as' (ID | '_'))? ';' | 'unsafe'? 'extern' STR? '{{' item* '}}';
    fn: ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' id generics? '(' (fnparam (',' fnparam)* ','?)? ')' ('->' type)? where? (block | ';');
    fnparam: attr* ('&' LIFE? )? 'mut'? 'self' (':' type)? | attr* pattern ':' (type | '...') | '...';
    fields: (attr* vis? id ':' type (',' attr* vis? id ':' type)* ','?)?;
    tfields: (attr* vis? type (',' attr* vis? type)* ','?)?;
    variant: attr* ID ('{{' fields '}}' | '(' tfields ')')? ('=' expr)?;
    usetree: '::'? (seg ('::' seg)*) ('::' ('*' | '{{' (usetree (',' usetree)* ','?)? '}}'))? ('as' (ID | '_'))? | '::'? ('*' | '{{' (usetree (',' usetree)* ','?)? '}}');
    seg: id | 'crate' | 'self' | 'super' | 'Self';
    path: '::'? seg ('::' seg)*;
    generics: '<' (generic (',' generic)* ','?)? '>';
    generic: attr* (LIFE (':' LIFE ('+' LIFE)*)? | 'const' ID ':' type ('=' expr)? | ID (':' bounds?)? ('=' type)?);
    where: 'where' (wherepred (',' wherepred)* ','?)?;
    wherepred: forlt? type ':' bounds? | LIFE ':' LIFE ('+' LIFE)*;
    forlt: 'for' '<' (LIFE (',' LIFE)*)? '>';
    bounds: bound ('+' bound)* '+'?;
    bound: LIFE | '?'? forlt? tpath | '(' '?'? forlt? tpath ')';
    tpath: '::'? tseg ('::' tseg)*;
    tseg: seg ('::'? targs | '(' (type (',' type)* ','?)? ')' ('->' type)?)?;
    targs: '<' (targ (',' targ)* ','?)? '>';
    targ: LIFE | type | ID '=' type | ID ':' bounds | '-'? NUM | STR | 'true' | 'false' | block;
    type: '!' | '(' (type (',' type)* ','?)? ')' | '[' type (';' expr)? ']' | ('&' | '&&') LIFE? 'mut'? typend | '*' ('const' | 'mut') typend | forlt? ('unsafe' | 'extern' STR?)* 'fn' '(' (((id | '_') ':')? type (',' ((id | '_') ':')? type)* ','?)? ')' ('->' type)?
        | ('impl' | 'dyn') bounds | tpath ('+' bounds)? | qpath | '_' | ID '!' ('(' any* ')' | '[' any* ']');
    typend: type;
    qpath: '<' type ('as' tpath)? '>' ('::' tseg)+;
    block: '{{' inner* bstmt* expr0? '}}';
    bstmt: ';' | attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | item | attr* expr ';' | attr* blocklike post* ';'? | attr* id '!' '{{' any* '}}';
    expr0: attr* expr;
    blocklike: (LIFE ':')? ('unsafe' | 'const' | 'async' 'move'?)? block | if | (LIFE ':')? ('loop' | 'while' cond | 'for' pattern 'in' expr) block | 'match' expr '{{' inner* arms '}}';
    if: 'if' cond block ('else' (if | block))?;
    cond: 'let' pattern '=' expr ('&&' cond)* | expr ('&&' 'let' pattern '=' expr)*;
    arms: (arm0 ','? )* ;
    arm0: attr* pattern ('if' cond)? '=>' expr;
    pattern: '|'? pat1 ('|' pat1)*;
    pat1: ('&' | '&&')* 'mut'? patatom;
    patatom: '_' | '..' | lit (('..=' | '..' | '...') (lit | path)?)? | ('..=' ) lit | 'ref'? 'mut'? id ('@' pattern)? | ppath ('(' (pattern (',' pattern)* ','?)? ')' | '{{' (fieldpat (',' fieldpat)* ','?)? '}}' | ('..=' | '..') (lit | path)?)?
        | '(' (pattern (',' pattern)* ','?)? ')' | '[' (pattern (',' pattern)* ','?)? ']' | id '!' '(' any* ')';
    fieldpat: attr* ('..' | 'ref'? 'mut'? id (':' pattern)? | NUM ':' pattern);
    ppath: '::'? seg ('::' (seg | targs))* | qpath;
    lit: '-'? NUM | STR | CHR | 'true' | 'false';
    expr: range | opnd tail* ('..' | '..=')? ;
    range: ('..' | '..=') (opnd tail*)?;
    tail: binop opnd | 'as' type | '?';
    binop: {_words(_RUST_BINARY)} | '>' '='? | '>' '>' '='? | '>=';
    opnd: ('-' | '!' | '*' | ('&' | '&&') ('mut' | 'raw' ('const' | 'mut'))?)* primary post*;
    primary: lit0 | epath structlit? | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (';' expr | (',' expr)* ','?))? ']' | blocklike | closure | 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | macro;
    macro: path '!' ('(' any* ')' | '[' any* ']' | '{{' any* '}}');
    lit0: NUM | STR | CHR | 'true' | 'false';
    epath: '::'? seg ('::' (seg | targs))* | qpath;
    structlit: '{{' (attr* (id | NUM) (':' expr)? (',' attr* (id | NUM) (':' expr)?)*)? ','? ('..' expr)? '}}';
    closure: ('static' | 'async' | 'move')* ('||' | '|' (cparam (',' cparam)* ','?)? '|') ('->' type block | expr);
    cparam: attr* pat1 (':' type)?;
    post: '.' (id ('::' targs)? | NUM | 'await') | args | '[' expr ']' | '?';
    args: '(' (expr (',' expr)* ','?)? ')';
    id: ID | 'union';
    word: ID | {_words("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union")};
"""

_C_BINARY = "+ - * / % << >> < > <= >= == != & ^ | && || = += -= *= /= %= &= |= ^= <<= >>="
_C_TYPE = "void char short int long float double signed unsigned _Bool"
_C_QUAL = "const volatile restrict static extern inline register auto typedef _Noreturn"
C = f"""
    file: external*;
    external: ';' | function | declaration | 'extern' STR ('{{' external* '}}' | external) | '_Static_assert' '(' expr ')' ';' | 'asm' args ';' | ID args ';'?;
    function: specs declarator attribute* declaration* block;
    specs: (spec0)+ ;
    spec0: {_words(_C_QUAL)} | {_words(_C_TYPE)} | struct | ID | attribute | '_Alignas' args;
    attribute: '__attribute__' '(' '(' any* ')' ')';
    any: ID | NUM | STR | ',' | '=' | 'const' | '(' any* ')';
    struct: ('struct' | 'union') attribute* (ID ('{{' member* '}}')? | '{{' member* '}}') | 'enum' (ID ('{{' enums '}}')? | '{{' enums '}}');
    member: specs (mdecl (',' mdecl)*)? ';' | ';' | '_Static_assert' '(' expr ')' ';';
    mdecl: declarator (':' cond)? attribute* | ':' cond;
    enums: enum0 (',' enum0)* ','?;
    enum0: ID ('=' cond)?;
    declaration: specs (init (',' init)*)? ';';
    init: declarator attribute* ('=' initializer)?;
    initializer: assign | '{{' (element (',' element)* ','?)? '}}';
    element: (('[' cond ']' | '.' ID)+ '=')? initializer;
    declarator: pointer* direct;
    pointer: '*' ('const' | 'volatile' | 'restrict')*;
    direct: (ID | '(' attribute* declarator ')') dsuffix*;
    dsuffix: '[' ('static' | 'const' | 'restrict')* (assign | '*')? ']' | '(' params ')';
    params: (param (',' param)* (',' '...')?)? | ID (',' ID)*;
    param: specs (declarator | abstract)?;
    abstract: pointer+ adirect? | adirect;
    adirect: ('(' abstract ')' | dsuffix) dsuffix*;
    typename: specs abstract?;
    block: '{{' (declaration | stmt)* '}}';
    stmt: block | expr? ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (declaration | expr? ';') expr? ';' expr? ')' stmt
        | 'switch' '(' expr ')' stmt | 'case' cond ('...' cond)? ':' stmt? | 'default' ':' stmt? | ID ':' stmt? | 'goto' ID ';' | 'break' ';' | 'continue' ';' | 'return' (expr | initializer)? ';' | '_Static_assert' '(' expr ')' ';';
    expr: assign (',' assign)*;
    assign: cond;
    cond: unary (binop unary | '?' expr? ':' unary)*;
    binop: {_words(_C_BINARY)};
    unary: prefix* (primary post*);
    prefix: '++' | '--' | '&' | '&&' | '*' | '+' | '-' | '~' | '!' | 'sizeof' | '(' typename ')';
    primary: ID | NUM | STR (STR | ID)* | CHR | '(' expr ')' | '(' block ')' | '(' typename ')' '{{' (element (',' element)* ','?)? '}}' | ('sizeof' | '_Alignof') '(' typename ')';
    args: '(' ((assign | typename) (',' (assign | typename))*)? ')';
    post: '[' expr ']' | args | '.' ID | '->' ID | '++' | '--';
"""

_RUBY_BINARY = "+ - * / % ** == != === =~ !~ <=> < <= > >= && || and or & | ^ << >> = += -= *= /= %= **= &= |= ^= <<= >>= &&= ||="
RUBY = f"""
    file: stmts;
    stmts: (stmt? (';' | NL))* stmt?;
    stmt: exprs (modifier)* | 'alias' fname fname | 'undef' fname (',' fname)* | ('BEGIN' | 'END') '{{' stmts '}}';
    modifier: MODIFIER exprs;
    exprs: expr (',' splat)*;
    splat: '*'? expr | '*';
    expr: opnd (binop 'not'? opnd | '?' expr ':' expr | '?' expr SYM | ('..' | '...') opnd? | 'in' opnd | '=>' opnd)* | ('..' | '...') opnd;
    binop: {_words(_RUBY_BINARY)};
    opnd: ('!' | '-' | '+' | '~' | '&' | '*' | '**' | 'defined' | '::' | 'not')* (primary post* | head command);
    head: id | CONST | 'super' | 'yield' | primary post* ('.' | '&.' | '::') mname;
    primary: id | CONST | VAR | NUM | STR+ | SYM | RE | 'nil' | 'true' | 'false' | 'self' | '__method__' | '(' stmts ')' | '[' elems ']' | '{{' pairs '}}' | 'super' | 'yield' | lambda | compound
        | 'return' expr? | 'break' expr? | 'next' expr? | 'redo' | 'retry' | TPL;
    lambda: '->' ('(' params ')' | param (',' param)*)? ('{{' stmts '}}' | 'do' bodystmt 'end');
    post: ('.' | '&.' | '::') (mname | '(' callargs ')') | '[' elems ']' | '(' callargs ')' | block;
    mname: id | CONST | {_words(KEY := "alias and begin break case class def defined do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield")} | {_words("+ - * / % == != < <= > >= << [ !")};
    block: '{{' bparams? stmts '}}' | 'do' bparams? bodystmt 'end';
    bparams: '|' params (';' id (',' id)*)? '|' | '||';
    command: (primary1 post* | head1 command | (id | CONST | STR) ':' expr? | lambda post*) ('=>' expr)? (',' callarg)* block*;
    head1: id | CONST | primary1 post* ('.' | '&.' | '::') mname;
    primary1: id | CONST | VAR | NUM | STR+ | SYM | RE | 'nil' | 'true' | 'false' | 'self' | compound;
    tail: binop 'not'? opnd | '?' expr ':' expr | ('..' | '...') opnd?;
    callargs: (callarg (',' callarg)* ','?)?;
    callarg: expr ('=>' expr)? | label expr? | '*' expr? | '**' expr? | '&' opnd?;
    label: (id | CONST | STR | {_words(KEY)}) ':';
    elems: (callarg (',' callarg)* ','?)?;
    pairs: (pair (',' pair)* ','?)? NL?;
    pair: expr '=>' expr | label expr? | '**' expr;
    compound: 'if' exprs then stmts ('elsif' exprs then stmts)* ('else' stmts)? 'end' | 'unless' exprs then stmts ('else' stmts)? 'end' | ('while' | 'until') exprs ('do' | NL | ';') stmts 'end'
        | 'for' splat (',' splat)* 'in' exprs ('do' | NL | ';') stmts 'end' | 'case' exprs? (NL | ';')* ('when' callarg (',' callarg)* then stmts)+ ('else' stmts)? 'end'
        | 'case' exprs (NL | ';')* ('in' callarg (',' callarg)* (('if' | 'unless') expr)? then stmts)+ ('else' stmts)? 'end' | 'begin' bodystmt 'end'
        | 'def' ((id | CONST | 'self') ('.' ))? fname ('(' params ')' | params0) (bodystmt 'end' | '=' stmt) | 'class' cpath ('<' expr)? bodystmt 'end' | 'class' '<<' expr bodystmt 'end' | 'module' cpath bodystmt 'end';
    then: 'then' | NL 'then'? | ';' 'then'?;
    bodystmt: stmts ('rescue' (callarg (',' callarg)*)? ('=>' expr)? ('then' | NL | ';') stmts)* ('else' stmts)? ('ensure' stmts)?;
    cpath: '::'? CONST ('::' CONST)*;
    fname: mname '='? | SYM | VAR | '[' ']' '='? | '+' '@' | '-' '@' | '**' | '<=>' | '===' | '=~';
    params: (param (',' param)* ','?)?;
    params0: (param (',' param)*)? (NL | ';');
    param: id ('=' expr)? | ('*' | '**' | '&') (id | 'nil')? | label expr? | '...' | '(' params ')';
    id: ID;
"""

GRAMMARS = {"javascript": _ecmascript(False), "typescript": _ecmascript(True), "python": PYTHON, "go": GO, "java": JAVA, "rust": RUST, "c": C, "ruby": RUBY}

#: Languages whose line breaks may end a statement but need not.
SKIP_NL = ("javascript", "typescript")
#: Languages whose line breaks mean nothing.
DROP_NL = ("java", "rust", "c")
