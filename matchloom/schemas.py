"""Fixed schemas of the nested columns (Spark DDL)."""

METADATA = "map<string,string>"

JOB_DESCRIPTION = (
    "struct<meta:struct<title:string,industry:string,location:string,source:string>,"
    "summary:string,responsibilities:array<string>,requirements:array<string>,"
    "skills:array<string>,competencies:array<struct<name:string,priority:int,"
    "evidenceIndicators:array<string>>>,keywords:array<string>,rawText:string>"
)

ROLE = "struct<title:string,company:string,startDate:string,endDate:string,achievements:array<string>>"
PROJECT = "struct<name:string,description:string>"

RESUME = (
    "struct<meta:struct<sourceKey:string,role:string,industry:string,outcome:string,updatedAt:string>,"
    f"summary:string,experience:array<{ROLE}>,education:array<string>,skills:array<string>,"
    f"projects:array<{PROJECT}>,rawText:string>"
)

STYLE_PROFILE = (
    "struct<sectionOrder:array<string>,headingCase:string,bulletStyle:string,fontFamily:string,"
    "fontSize:int,layoutDensity:string,includeSectionDividers:boolean,accentColor:string>"
)

STYLE_METADATA = (
    "struct<sectionOrder:array<string>,headingCase:string,bulletStyle:string,fontFamily:string,"
    "fontSize:double,layoutDensity:string,includeSectionDividers:boolean,accentColor:string>"
)

CHANGE_LOG = "array<struct<type:string,detail:string,rationale:string>>"
COVER_LETTER = "struct<intro:string,body:string,tone:string>"
ISSUES = "array<struct<code:string,message:string>>"
CHUNKS = "array<struct<text:string,score:double,metadata:map<string,string>,tags:array<string>>>"
COMPETENCIES = "struct<competencies:array<struct<name:string,priority:int,evidenceIndicators:array<string>>>>"
DELTA = (
    "struct<changes:array<struct<section:string,action:string,detail:string,rationale:string,"
    "evidence:array<string>>>>"
)
PROMPTS = "map<string,struct<description:string,template:string,stopSequences:array<string>>>"
GENERATION = f"struct<tailoredResume:{RESUME},changeLog:{CHANGE_LOG},coverLetter:{COVER_LETTER}>"

DOCUMENT_POINTER = "struct<s3Key:string,text:string,metadata:map<string,string>,documentType:string>"
