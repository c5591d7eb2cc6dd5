"""Routes lead to handlers, folders make routes, and components are found."""

from pyspark.sql import functions as F

from symweave.operators import extract, frameworks

SOURCES = {
    "r.js": "app.get('/users', auth, users.list);\nrouter.post(\"/login\", login);\n",
    "urls.py": "urlpatterns = [\n    path('a/<int:id>/', views.detail),\n    path('b/', ListView.as_view(), name='b'),\n    path('c/', include('shop.urls')),\n]\n",
    "v.py": "@app.route('/home')\n@login_required\ndef home():\n    pass\n\n@app.get('/next')\nasync def following():\n    pass\n",
    "web.php": "<?php\nRoute::get('/p', [PageController::class, 'show']);\nRoute::post('/q', 'PageController@store');\n",
    "routes.rb": "get '/x', to: 'home#index'\n",
    "S.java": "class S {\n  @GetMapping(\"/s\")\n  public String read() {\n    return null;\n  }\n}\n",
    "main.go": "package main\nfunc main() {\n\tr.GET(\"/g\", handlers.Show)\n}\n",
    "a.rs": "#[get(\"/r\")]\nasync fn ready() {}\nfn app() { x.route(\"/ax\", get(hello)); }\n",
    "C.cs": "class C {\n  [HttpGet(\"/c\")]\n  public string Read() {\n  }\n}\n",
    "P.cs": "app.MapGet(\"/m\", Mapped);\n",
    "n.ts": "export class Cats {\n  @Get('all')\n  all(): string {\n    return '';\n  }\n}\n",
    "v.swift": "app.get(\"v\", use: api.show)\nstruct Home: View {\n}\n",
    "pages/blog/[id].tsx": "export function Post() {\n  return <Card/>;\n}\nexport function useThing() {\n  useState(1);\n}\n",
    "app/(shop)/cart/page.tsx": "export default function Cart() {\n  return null;\n}\n",
    "src/routes/docs/[...rest]/+page.svelte": "<h1>x</h1>\n",
    "pages/index.vue": "<template></template>\n",
    "server/api/user.post.ts": "export default 1;\n",
}


def test_frameworks(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "path string, text string").withColumn("language", extract.language_of(F.col("path"), F.col("text")))
    found = extract.symbols(files)
    handled = frameworks.handlers(files, found)
    got = {(r.path, r.url): r.handler for r in handled.collect()}
    assert got == {
        ("r.js", "/users"): "list", ("r.js", "/login"): "login", ("urls.py", "a/<int:id>/"): "detail", ("urls.py", "b/"): "ListView", ("urls.py", "c/"): None, ("v.py", "/home"): "home", ("v.py", "/next"): "following",
        ("web.php", "/p"): "show", ("web.php", "/q"): "store", ("routes.rb", "/x"): "index", ("S.java", "/s"): "read", ("main.go", "/g"): "Show", ("a.rs", "/r"): "ready", ("a.rs", "/ax"): "hello",
        ("C.cs", "/c"): "Read", ("P.cs", "/m"): "Mapped", ("n.ts", "/all"): "all", ("v.swift", "v"): "show",
    }
    refs = [(r.reference_kind, r.reference_name) for r in frameworks.route_references(handled, files).collect()]
    assert sorted(refs) == sorted([("imports", "shop.urls"), *(("references", h) for h in got.values() if h)])
    nodes = {(r.id, r.name) for r in frameworks.route_nodes(handled, files).collect()}
    assert len(nodes) == 18 and {n for _, n in nodes} >= {"GET /users", "POST /login"}
    pages = {(r.framework, r.url) for r in frameworks.page_routes(files).collect()}
    assert pages == {("next", "/blog/:id"), ("next", "/cart"), ("sveltekit", "/docs/*"), ("nuxt", "/"), ("nuxt", "/api/user")}
    parts = {(r.framework, r.kind, r.name) for r in frameworks.components(files, found).collect()}
    assert parts == {("react", "component", "Post"), ("react", "function", "useThing"), ("react", "component", "Cart"), ("svelte", "component", "+page"), ("vue", "component", "index"), ("swift", "component", "Home")}
    calls = {r.reference_name for r in frameworks.project_references(extract.references(files, found)).collect()}
    assert "useState" not in calls and "Card" in calls


NEST = """import { Controller } from '@nestjs/common';
@Controller({ path: '/cats/', host: 'x' })
export class Cats {
  @Get(':id') @HttpCode(204)
  one(@Param('id') id: string, @Query('q') q: string): string {
    return '';
  }
  @Post()
  @UseGuards(A('x'))
  async make(): Promise<X> {
  }
  // @Get('gone')
  @Query('unseen')
  other() {
  }
}
@Resolver(() => User)
export class Users {
  @Query(() => [User], { name: 'users' })
  all() {
  }
  @Mutation(() => User, { description: 'no name' })
  addUser() {
  }
}
@WebSocketGateway(81, { namespace: 'chat' })
export class Chat {
  @SubscribeMessage('send')
  sent() {
  }
  @EventPattern()
  happened() {
  }
  @MessagePattern({ cmd: 'sum' })
  sum() {
  }
}
@Injectable()
export class Plain {
  @Head() @Header('a', 'b')
  head() {
  }
}
"""


def test_routes_begin_with_what_the_class_says(spark):
    texts = [("src/c.ts", NEST), ("empty.ts", ""), ("null.ts", None), ("web.php", "<?php\nRoute::apiResource('photos', PhotoController::class);\nRoute::resource('/tags/', TagController::class);\n"), ("routes.rb", "resources :books\n")]
    files = spark.createDataFrame(texts, "path string, text string").withColumn("language", extract.language_of(F.col("path"), F.col("text")))
    handled = frameworks.handlers(files, extract.symbols(files))
    assert {(r.method, r.url, r.handler) for r in handled.filter("framework = 'nest'").collect()} == {
        ("GET", "/cats/:id", "one"), ("POST", "/cats", "make"), ("QUERY", "users", "all"), ("MUTATION", "addUser", "addUser"), ("WS", "chat:send", "sent"),
        ("EVENT", "happened", "happened"), ("MESSAGE", "sum", "sum"), ("HEAD", "/", "head"),
    }
    made = sorted((r.path, r.method, r.url, r.handler) for r in frameworks.resources(handled).collect())
    rest = lambda path, base, key, put, forms: [(path, "GET", base, "index"), (path, "POST", base, "create" if put == "PATCH" else "store"), (path, "GET", f"{base}/{key}", "show"), (path, put, f"{base}/{key}", "update"), (path, "DELETE", f"{base}/{key}", "destroy"), *([(path, "GET", f"{base}/{forms}", forms), (path, "GET", f"{base}/{key}/edit", "edit")] if forms else [])]
    assert made == sorted(rest("web.php", "/photos", "{id}", "PUT", "") + rest("web.php", "/tags", "{id}", "PUT", "create") + rest("routes.rb", "/books", ":id", "PATCH", "new"))
